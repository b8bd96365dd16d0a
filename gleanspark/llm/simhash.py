"""SimHash near-duplicates: 64-bit fingerprints, linked exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.components import Forest, components
from gleanspark.llm.shared import stored, utf8

SEED = 42
SAMPLE_ROWS = 32_768  # fingerprints from which the shared tree is cut; at most 32 times as many
SHARD_ROWS = 16_384  # fingerprints a shard should hold
LEAF_ROWS = 768  # below this, one block of all distances
_BITS = 64


def fingerprint(data: bytes, words: int = 3) -> int:
    """SimHash of a text's word shingles, as an unsigned number."""
    tokens = bytes(data).lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [
            digest(joined[s:e], SEED)
            for s, e in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        ],
        np.uint64,
    )
    n, ones = len(hashes), np.zeros(_BITS, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(text: Column, words: int = 3) -> Column:
    """Column of SimHash fingerprints (the 64 bits as a signed long).

    A-Z are lower-cased; words are runs of characters other than space and 0x09-0x0D; shingles
    are ``words`` of them joined by a space, repeats counted; a text of fewer words is one
    shingle; no words or null gives 0. Bit b is 1 if it is set in more than half of the
    shingles' XXH64 values (seed 42).
    """

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return prints(utf8(text))


# A vantage-point tree is a list of nodes (vantage, cut, inner, outer); a child is a node number,
# or -1 - shard at the bottom. Points within the cut's distance of the vantage point belong inside.


def best_cut(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and distance that leave the least work on both sides together, or None
    if every cut leaves most of it."""
    n, best, cost = len(points), None, 0.8
    for v in points[np.linspace(0, n - 1, 12).astype(int)]:
        at = np.bincount(np.bitwise_count(points ^ v), minlength=_BITS + 1)
        upto = np.cumsum(at) / n
        for cut in range(_BITS):
            inner = upto[min(_BITS, cut + radius - radius // 2)]
            outer = 1 - (upto[cut - radius // 2] if cut >= radius // 2 else 0)
            if max(inner, outer) < 1 and inner**2 + outer**2 < cost:
                best, cost = (v, cut), inner**2 + outer**2
    return best


def sides(points: np.ndarray, vantage: np.uint64, cut: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside and which outside; those whose ball crosses the cut go both ways.

    By the triangle inequality two points within ``radius`` of each other differ by at most that
    in their distance to the vantage point. The overlap is shared between the sides: of any such
    pair that the cut parts, one point lies in the other's side too.
    """
    far = np.bitwise_count(points ^ vantage).astype(np.int16)
    return far <= cut + radius - radius // 2, far > cut - radius // 2


def grow(sample: np.ndarray, each: float, shard_rows: int, radius: int) -> list[tuple[int, int, int, int]]:
    """A tree over a sample in which a point stands for ``each`` fingerprints."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def node(points: np.ndarray) -> int:
        nonlocal shards
        found = best_cut(points, radius) if len(points) >= 32 and len(points) * each > shard_rows else None
        if found is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        inner, outer = sides(points, *found, radius)
        nodes[at] = (int(found[0]), found[1], node(points[inner]), node(points[outer]))
        return at

    node(sample)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and shards: every shard that a point's own side of the overlaps reaches."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    rows, shards, todo = [], [], [(0, np.arange(len(points)))]
    while todo:
        at, these = todo.pop()
        if not len(these):
            continue
        if at < 0:
            rows.append(these)
            shards.append(np.full(len(these), -1 - at))
            continue
        vantage, cut, inner, outer = nodes[at]
        inside, outside = sides(points[these], np.uint64(vantage), cut, radius)
        todo += [(inner, these[inside]), (outer, these[outside])]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(shards)


def link_shard(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point of a shard the number of its group's first point, at ``radius`` bits or fewer.

    The tree is continued in memory down to small blocks. Where no cut pays (a dense cluster) the
    group is flooded from its own points, so no list of all its pairs is ever made.
    """
    forest = Forest(len(points))

    def flood(these: np.ndarray) -> None:
        left = these
        while len(left):
            front, left = left[:1], left[1:]
            root = front
            while len(front) and len(left):
                near = np.zeros(len(left), bool)
                for part in np.array_split(front, max(1, len(front) * len(left) // 4_000_000)):
                    near |= (np.bitwise_count(points[part][:, None] ^ points[left][None, :]) <= radius).any(axis=0)
                front, left = left[near], left[~near]
                forest.link(np.repeat(root, len(front)), front)

    def pairs(these: np.ndarray) -> None:
        near = np.bitwise_count(points[these][:, None] ^ points[these][None, :]) <= radius
        if np.count_nonzero(near) > 16 * len(these):
            flood(these)
            return
        a, b = np.nonzero(near)
        keep = a < b
        forest.link(these[a[keep]], these[b[keep]])

    todo = [np.arange(len(points))]
    while todo:
        these = todo.pop()
        if len(these) <= LEAF_ROWS:
            pairs(these)
            continue
        mine = points[these]
        found = best_cut(mine[:: max(1, len(mine) // 4096)], radius)
        if found is None:
            flood(these)
            continue
        inner, outer = sides(mine, *found, radius)
        if min(np.count_nonzero(inner), np.count_nonzero(outer)) == 0 or inner.all() or outer.all():
            flood(these)
            continue
        todo += [these[inner], these[outer]]
    return forest.roots()


def link_fingerprints(
    prints: DataFrame, radius: int = 2, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``fingerprint, root``: groups of the distinct fingerprints linked at ``radius`` bits or fewer.

    ``prints`` has one row per fingerprint (long). A vantage-point tree is cut from a bounded
    sample chosen by hash (``sample_rows``, or a thousandth of the rows up to 32 times that
    many); the tree, not the sample, goes to the tasks, and every fingerprint is routed to each
    shard that its ball reaches. A shard above ``shard_rows`` after routing, which is a cluster
    no cut divides, is dealt as cells of two blocks, so no task holds more than two blocks.
    Shards report a forest of links; the components of all forests are the groups. Fingerprints
    without links are not listed.
    """
    rows = prints.count()
    want = max(sample_rows, min(rows // 1000, 32 * sample_rows))
    share = max(1, rows // max(1, want))
    chosen = prints.where(F.pmod(F.xxhash64(F.col("fingerprint"), F.lit(7)), F.lit(share)) == 0)
    sample = np.array([r[0] for r in chosen.select("fingerprint").limit(2 * want).collect()], np.int64)
    sample = np.sort(sample.view(np.uint64))
    nodes = grow(sample[np.random.default_rng(1).permutation(len(sample))], share, shard_rows, radius)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy()
            at, shards = route(points.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(points[at])], ["shard", "fingerprint"])

    placed = prints.select("fingerprint").mapInArrow(routed, "shard long, fingerprint long")
    sizes = placed.groupBy("shard").count()
    blocks = sizes.select(
        "shard", F.ceil(F.col("count") / F.lit(2 * shard_rows)).cast("int").alias("blocks")
    )
    dealt = (
        placed.join(blocks, "shard")
        .withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "shard",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "fingerprint",
        )
    )

    def linked(shard: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(shard["fingerprint"].to_numpy())
        roots = link_shard(points.view(np.uint64), radius)
        hung = roots != np.arange(len(points))
        return pd.DataFrame({"a": points[hung], "b": points[roots[hung]]})

    forests = dealt.groupBy("shard", "i", "j").applyInPandas(linked, "a long, b long")
    return components(forests).select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))


def grouped(printed: DataFrame, radius: int = 2) -> DataFrame:
    """``fingerprint, component_id`` for every fingerprint of ``printed`` (``doc_id, fingerprint``)."""
    distinct = stored(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = distinct.join(link_fingerprints(distinct, radius), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    named = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return linked.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Equal fingerprints link,
    so copies are one fingerprint before any search. ``component_id`` is the smallest doc_id
    reachable. Null and empty texts share fingerprint zero and link like any other. A null
    doc_id is ignored as a name: such rows get their group's id, null if nobody in it has one.
    Repeated rows stay; an empty table gives no rows.
    """
    printed = stored(docs.select("doc_id", fingerprints(F.col("text"), words).alias("fingerprint")), "simhash")
    return printed.join(grouped(printed, radius), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
