"""Joins that hold up when one key owns a large share of the rows.

``lookup_join`` picks between three strategies, each behind a check of its size:

1. the looked-up side is small: broadcast it;
2. the looking side has few distinct keys: cut the looked-up side down to those keys
   first, then broadcast what is left;
3. both sides are large: shuffle join, with the heaviest keys spread over several tasks.

The limits are session settings, so a cluster can raise them and a test can force
any of the three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanspark.plans.durable import settle

# setting -> default
LIMITS = {
    "gleanspark.broadcast.maxRows": 200_000,
    "gleanspark.broadcast.maxBytes": 64 * 1024 * 1024,
    "gleanspark.hotKey.rows": 1_000_000,
    "gleanspark.ordered.maxRows": 200_000,
}

_TEXT = (T.StringType, T.BinaryType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_SIZED = (*_TEXT, *_NESTED)
SALT = "__salt"
SPLITS = "__splits"
_ROWS = "__rows"


def limit_of(spark: SparkSession, name: str) -> int:
    """Read one of ``LIMITS`` from the session, falling back to its default."""
    return int(spark.conf.get(name, str(LIMITS[name])))


def _width(field: T.StructField) -> Column:
    """Bytes a value takes, measured for text and estimated for fixed-width types."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _TEXT):
        return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, _NESTED):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) * 2 + F.lit(16)
    return F.lit(16)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df`` stays within the broadcast limits, by rows and by bytes.

    One aggregate over its text columns alone; a single row reaches the driver.
    """
    spark = df.sparkSession
    max_rows = limit_of(spark, "gleanspark.broadcast.maxRows")
    if max_rows < 1:
        return False
    width = F.lit(0).cast("bigint")
    for field in df.schema:
        width = width + _width(field)
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= limit_of(spark, "gleanspark.broadcast.maxBytes")


def _hot_keys(counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every key above ``hotKey.rows`` rows and how many tasks it is spread over, by its count.

    The list is bounded by the rows divided by ``hotKey.rows``. A NULL key matches nothing and
    is never hot.
    """
    rows = limit_of(counts.sparkSession, "gleanspark.hotKey.rows")
    known = F.lit(True)
    for name in on:
        known = known & F.col(name).isNotNull()
    return counts.where(known & (F.col(_ROWS) > rows)).select(
        *on, F.ceil(F.col(_ROWS) / rows).cast("int").alias(SPLITS)
    )


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """The keys of ``df`` heavy enough to be spread over several tasks, None if there are none."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias(_ROWS))
    hot = settle(_hot_keys(counts, on))
    return None if hot.isEmpty() else hot


def salt_of(df: DataFrame, splits: Column) -> Column:
    """A salt in ``0 .. splits-1`` from the row and its partition: a recomputed task agrees, and
    equal rows of different partitions are told apart."""
    parts = [F.col(f"`{c}`") for c in _hashable(df)]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *parts), splits).cast("int")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def shuffle_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two large sides, by shuffle whatever the planner takes their sizes for.

    It takes the packed size of stored files for the size of their rows, and so would send tables
    of many times its broadcast limit through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def _salted_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str, hot: DataFrame) -> DataFrame:
    """Join on the key plus a salt; only hot keys have more than one salt value.

    A NULL key matches nothing: those rows go past the join and are never shuffled.
    """
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    spread = (
        fact.where(~no_key)
        .join(F.broadcast(hot), list(on), "left")
        .withColumn(SALT, F.when(F.col(SPLITS).isNotNull(), salt_of(fact, F.col(SPLITS))).otherwise(F.lit(0)))
        .drop(SPLITS)
    )
    copies = (
        dim.join(F.broadcast(hot), list(on), "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(SPLITS), F.lit(1)) - 1)))
        .drop(SPLITS)
    )
    joined = shuffle_join(spread, copies, [*on, SALT], how).drop(SALT)
    if how in ("left", "left_anti"):
        return joined.unionByName(fact.where(no_key), allowMissingColumns=True)
    return joined


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    unique: bool = False,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join ``fact`` to ``dim``, which has at most one row per key (``on``).

    ``how`` is inner, left, left_semi or left_anti. Keys come first in the result, as
    with any join on column names.

    ``unique`` states that ``fact`` has one row per key as well, so no key can be hot and
    none is counted. ``keys_from`` is a cheaper frame with the fact's keys, row for row, to
    count them in.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dim):
        return fact.join(F.broadcast(dim), keys, how)

    counted = fact if keys_from is None else keys_from
    if unique:
        wanted = counted.select(*keys)
    else:
        counts = settle(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS)))
        wanted = counts.select(*keys)
    if fits_broadcast(wanted):
        # at most one row per wanted key: settled, so that a large table is scanned once
        dim = settle(dim.join(F.broadcast(wanted), keys, "left_semi"))
        if fits_broadcast(dim):
            return fact.join(F.broadcast(dim), keys, how)
    if unique:
        return shuffle_join(fact, dim, keys, how)

    hot = settle(_hot_keys(counts, keys))
    if hot.isEmpty():
        return shuffle_join(fact, dim, keys, how)
    return _salted_join(fact, dim, keys, how, hot)


def keys_present(keys: DataFrame, table: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The distinct ``keys`` rows that occur in ``table``, settled.

    When the keys are few, the table is only filtered by a broadcast and never
    shuffled whole; duplicates are combined before any shuffle.
    """
    names = [on] if isinstance(on, str) else list(on)
    wanted = settle(keys.select(*names).distinct())
    held = table.select(*names)
    if fits_broadcast(wanted):
        return settle(held.join(F.broadcast(wanted), names, "left_semi").distinct())
    return settle(shuffle_join(held.distinct(), wanted, names, "left_semi"))
