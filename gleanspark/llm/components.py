"""Connected components by forests of bounded parts, then alternating star contractions, as DataFrame
joins and groupings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.shared import stored

TASK_EDGES = 1 << 16  # edges (16 bytes each) that a task makes a forest of at a time


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of those neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _forests(edges: DataFrame, rows: int) -> DataFrame:
    """``a, b``: for the edges a task holds at a time, at most ``TASK_EDGES``, every node beside the
    smallest one of its component among them, that one beside itself."""

    def hung(parts: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
        nodes, at = np.unique(ends, return_inverse=True)
        forest = Forest(len(nodes))
        forest.link(*at.reshape(2, -1))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.roots()])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], TASK_EDGES
        for batch in batches:
            ends = np.stack([batch.column(i).to_numpy() for i in range(2)])
            while ends.shape[1]:
                held.append(ends[:, :room])
                ends, room = ends[:, room:], room - held[-1].shape[1]
                if not room:
                    yield hung(held)
                    held, room = [], TASK_EDGES
        if held:
            yield hung(held)

    # a few edges to hundreds of tasks would cost the driver more than the edges themselves
    return edges.coalesce(-(-rows // TASK_EDGES)).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the undirected edges ``a, b`` (long): component is the smallest node.

    Tasks replace up to ``TASK_EDGES`` edges at a time by a forest of theirs, which ends it where
    there are no more edges than that. Of more, the forests go through rounds. Every round is two
    groupings with a map-side part and two joins of edges with one row per node, which adaptive
    execution splits at a hub; it is stored before the next one. Rounds grow with the logarithm of
    the longest chain. Nodes without an edge to another node do not occur in the result; null ends
    and loops are ignored, repeated edges count once.
    """
    current = stored(_larger_first(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    rows = current.count()
    if rows:
        current = stored(_forests(current, rows), "forests")
    if rows <= TASK_EDGES:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    current = stored(_larger_first(current), "edges")
    before = None
    while True:
        print_of = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        now = (print_of["n"], print_of["h"])
        if now == before:
            break
        before = now
        current = stored(_small_star(_large_star(current)), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


class Forest:
    """Union-find over ``0 .. n-1``: the links found in one shard, kept as one tree per group."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                return up
            parent = up
