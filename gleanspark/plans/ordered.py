"""Requests decided one by one in ``seq`` order, each depending on earlier ones it shares a key with.

Few enough of them are decided in one ordered pass. More are parted into the groups that shared
keys connect: what is in different groups never meets, so small groups are passed over side by side,
many to a task. Groups above the limit are handed back to the caller, who settles part of them in
rounds over the whole frame.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanspark.plans.durable import written
from gleanspark.plans.skew import limit_of, shuffle_join

BUNDLES_OF_LIMIT = 16  # bundles over which as many rows as one pass may hold are dealt


def pass_limit(spark: SparkSession) -> int:
    """Rows that one ordered pass in one task may hold (``gleanspark.ordered.maxRows``)."""
    return limit_of(spark, "gleanspark.ordered.maxRows")


def one_pass(rows: DataFrame, decide: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """``decide`` over all rows in ``seq`` order, in one task. For counted rows only."""
    return _passed(rows.withColumn("__bundle", F.lit(0)), decide, schema)


def _passed(rows: DataFrame, decide, schema) -> DataFrame:
    def in_order(part):
        return decide(part.drop(columns="__bundle").sort_values("seq"))

    return rows.groupBy("__bundle").applyInPandas(in_order, schema)


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` of undirected edges ``a, b`` (long): component is one node of it, the same
    for all. Nodes without an edge to another do not occur.

    In each round every node goes over to the first of itself and its neighbours in an order drawn
    anew, and the edges between those go on. A path halves, anything denser shrinks faster, so all
    rounds together move little more than the first two. The steps are then followed back.
    """
    current = written(_between(edges.select("a", "b")))
    steps: list[DataFrame] = []
    while not current.isEmpty():
        drawn = lambda c: F.xxhash64(c, F.lit(len(steps)))
        both = current.union(current.select("b", "a"))
        first = both.groupBy("a").agg(F.min(drawn("b")).alias("h"), F.min_by("b", drawn("b")).alias("m"))
        steps.append(
            written(first.select(F.col("a").alias("node"), F.when(drawn("a") < F.col("h"), F.col("a")).otherwise(F.col("m")).alias("to")))
        )
        moved = current
        for end in ("a", "b"):
            over = steps[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
            moved = shuffle_join(moved, over, end)
        current = written(_between(moved.select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
    if not steps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps.pop().withColumnRenamed("to", "component")
    while steps:
        later = found.withColumnRenamed("node", "to")
        found = shuffle_join(steps.pop(), later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        found = written(found)
    return found


def _between(edges: DataFrame) -> DataFrame:
    """Each edge of two different nodes once."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def by_components(
    rows: DataFrame, links: Column, decide: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str
) -> tuple[DataFrame, DataFrame]:
    """Rows of small components decided, and the rows of components above the limit.

    ``rows`` is a stored frame. ``links`` is an array of hashes of a row's keys (long); rows with a
    hash in common are in one component. Equal hashes of different keys join components and change
    no decision.
    """
    limit = pass_limit(rows.sparkSession)
    # a row without a key meets no other
    node = F.coalesce(F.get(links, F.lit(0)), F.xxhash64(F.lit("seq"), "seq"))
    nodes = connected(rows.select(node.alias("a"), F.explode(links).alias("b")))
    linked = shuffle_join(rows.withColumn("node", node), nodes, "node", "left")
    grouped = written(linked.withColumn("component", F.coalesce("component", "node")).drop("node"))
    sizes = grouped.groupBy("component").count()
    giants = F.broadcast(sizes.where(F.col("count") > limit).select("component"))  # at most rows / limit
    small = grouped.join(giants, "component", "left_anti")
    # a bundle of small components stays far below the limit; a worker holds one at a time
    bundles = grouped.count() * BUNDLES_OF_LIMIT // max(1, limit) + 1
    small = small.withColumn("__bundle", F.pmod(F.xxhash64("component"), F.lit(bundles))).drop("component")
    return _passed(small, decide, schema), grouped.join(giants, "component", "left_semi").drop("component")
