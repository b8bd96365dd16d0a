import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanspark.llm.components import components
from gleanspark.llm.queries import QUERIES
from gleanspark.llm.simhash import best_cut, fingerprint, grow, link_fingerprints, link_shard, route, simhash_groups
from tests.conftest import SMALL
from tests.llm.cases import ROWS, no_docs, odd_docs


def slow_fingerprint(text, words=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius, names=None):
    """Smallest name reachable, by comparing all pairs."""
    names = list(range(len(prints))) if names is None else names
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(prints)):
        if names[i] is not None:
            least[find(i)] = min(least.get(find(i), names[i]), names[i])
    return [least.get(find(i)) for i in range(len(prints))]


def clustered(seed, n):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(max(1, n // 10))]
    out = set()
    while len(out) < n:
        p = rnd.choice(centres)
        for _ in range(rnd.choice((0, 1, 2, 3, 5))):
            p ^= 1 << rnd.randrange(64)
        out.add(p)
    return sorted(out)


def test_fingerprint_is_as_defined():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["Ab", "c", "É", "D e", "f\x1cg"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 300)]
    for text in [*texts, " \n", "a\x0bb\x0cc d"]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_shards_of_the_tree_lose_no_pair(radius):
    prints = np.array(clustered(radius, 1500), np.uint64)
    nodes = grow(prints[np.random.default_rng(0).permutation(len(prints))], 1, 100, radius)
    assert nodes and best_cut(prints, radius) is not None
    rows, shards = route(prints, nodes, radius)
    held = {}
    for r, s in zip(rows.tolist(), shards.tolist()):
        held.setdefault(r, set()).add(s)
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius, 1))
    assert len(near) > 100
    assert all(held[a] & held[b] for a, b in near.tolist())


@pytest.mark.parametrize("n", [0, 1, 700, 2500])
def test_a_shard_is_linked_as_by_all_pairs(n):
    prints = clustered(n, n) if n else []
    roots = link_shard(np.array(prints, np.uint64), 2)
    assert roots.tolist() == groups(prints, 2)


def test_a_dense_cluster_is_flooded():
    rnd = random.Random(8)
    prints = sorted({(1 << 40) ^ sum(1 << rnd.randrange(8) for _ in range(4)) for _ in range(4000)} | {7 << 50})
    assert link_shard(np.array(prints, np.uint64), 2).tolist() == groups(prints, 2)


@pytest.mark.parametrize("shard_rows", [40, 16_384])
def test_links_over_shards_and_cells(spark, shard_rows):
    prints = clustered(3, 1200)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {r.fingerprint: r.root for r in link_fingerprints(frame, 2, sample_rows=300, shard_rows=shard_rows).collect()}
    order = {}
    for p, root in zip(signed, groups(prints, 2)):
        order.setdefault(root, []).append(p)
    want = {p: min(ps) for ps in order.values() for p in ps if len(ps) > 1}
    assert got == want


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, None), (3, 2), (2, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    prints = [slow_fingerprint(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], zip([f"{p:016x}" for p in prints], groups(prints, 2, [r.doc_id for r in docs]))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SMALL).collect()}
    assert got == want


def test_odd_rows(spark):
    got = sorted(simhash_groups(odd_docs(spark)).collect(), key=str)
    prints = [slow_fingerprint(t) for _, t in ROWS]
    want = [(i, f"{p:016x}", g) for (i, _), p, g in zip(ROWS, prints, groups(prints, 2, [i for i, _ in ROWS]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash_groups(no_docs(spark)).count() == 0
    assert simhash_groups(odd_docs(spark).where(F.col("doc_id") == 1)).collect() == [(1, "0" * 16, 1)]
