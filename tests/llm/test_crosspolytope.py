import numpy as np
import pytest

from gleanspark.llm.crosspolytope import embedding_groups, hadamard, shape_for
from gleanspark.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(ids, vectors, cosine=0.9):
    x = np.array(vectors, np.float64)
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (n[:, None] * n[None, :]) >= cosine
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}
    for _ in range(len(ids)):
        before = dict(root)
        for a, b in np.argwhere(near).tolist():
            least = min(root[ids[a]], root[ids[b]])
            root[ids[a]] = root[ids[b]] = least
        if root == before:
            break
    return {i: (int(k), root[i], root[i] == i) for i, k in zip(ids, near.sum(axis=1))}


def of(frame):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in frame.collect()}


def test_hadamard_keeps_lengths_and_turns_back():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_buckets_follow_the_rows():
    for rows in (1, 100, 10_000, 10_000_000):
        buckets = np.prod([2 * p for p in shape_for(64, rows, 96)])
        assert rows / 96 / 2 <= buckets or buckets == 2
        assert buckets <= max(2, 2 * rows / 96)


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_clusters_against_all_pairs(spark, block_rows):
    random = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = random.normal(size=24)
        spread = random.choice([0.05, 0.25, 0.4])
        rows += [centre + spread * random.normal(size=24) for _ in range(25)]
    rows += [rows[0]] * 60 + list(random.normal(size=(200, 24)))
    vectors = [[float(v) for v in np.float32(r)] for r in rows]
    ids = random.permutation(len(vectors)).tolist()
    frame = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")
    got, want = of(embedding_groups(frame, block_rows=block_rows, bucket_rows=24)), brute(ids, vectors)
    links, found = sum(v[0] for v in want.values()), sum(v[0] for v in got.values())
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert found >= 0.99 * links > 0


def test_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    assert of(QUERIES["op2_crosspolytope"](spark, SMALL)) == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cls", "2 AS table")
    got = sorted(map(tuple, embedding_groups(frame).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    want = [(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (10, 2, 1, False), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)]
    assert got == sorted(want, key=str)
    assert embedding_groups(frame.where("false")).count() == 0
