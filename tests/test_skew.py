"""The join strategies give the same rows, also with one key holding a third of them."""

import pytest
from pyspark.sql import functions as F

from gleanspark.plans import skew


@pytest.fixture(scope="module")
def sides(spark):
    fact = spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 200).alias("k"),
    )
    dim = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return fact, dim


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", ["default", "reduced", "salted", "plain"])
def test_lookup_join(spark, limits, sides, how, limit):
    fact, dim = sides
    if limit == "reduced":  # 150 rows are too many; the 11 keys of the narrow fact are not
        fact = fact.where("k < 11 or k is null")
        limits(broadcast_maxRows=20)
    if limit == "salted":
        limits(broadcast_maxRows=0, hotKey_rows=100)
    if limit == "plain":
        limits(broadcast_maxRows=0)
    want = sorted(map(str, fact.join(dim, ["k"], how).collect()))
    assert sorted(map(str, skew.lookup_join(fact, dim, "k", how).collect())) == want


def test_hot_key_is_spread(spark, limits, sides):
    fact, dim = sides
    limits(broadcast_maxRows=0, hotKey_rows=100)
    hot = {r["k"]: r[skew.SPLITS] for r in skew.hot_keys(fact.where("k is not null"), ["k"]).collect()}
    assert hot == {7: 11}
    joined = skew.lookup_join(fact, dim, "k")
    plan = joined._jdf.queryExecution().toString()
    assert "__salt" in plan


def test_two_column_keys(spark, limits):
    fact = spark.range(500).select("id", (F.col("id") % 2).alias("a"), (F.col("id") % 5).alias("b"))
    dim = spark.createDataFrame([(0, 0, "x"), (1, 3, "y")], "a long, b long, v string")
    want = sorted(map(str, fact.join(dim, ["a", "b"], "left").collect()))
    limits(broadcast_maxRows=0, hotKey_rows=20)
    assert sorted(map(str, skew.lookup_join(fact, dim, ["a", "b"]).collect())) == want


def test_fits_broadcast_by_rows_and_bytes(spark, limits):
    limits(broadcast_maxRows=100, broadcast_maxBytes=10_000)
    assert skew.fits_broadcast(spark.range(100))
    assert not skew.fits_broadcast(spark.range(101))
    assert not skew.fits_broadcast(spark.range(10).select(F.repeat(F.lit("x"), 2000).alias("text")))
    assert skew.fits_broadcast(spark.range(10).select(F.repeat(F.lit("x"), 200).alias("text")))
    assert skew.fits_broadcast(spark.range(0))


def test_keys_present(spark, limits):
    keys = spark.createDataFrame([(1,), (1,), (5,), (9,)], "k long")
    table = spark.range(6).withColumnRenamed("id", "k")
    want = [1, 5]
    assert sorted(r["k"] for r in skew.keys_present(keys, table, "k").collect()) == want
    limits(broadcast_maxRows=0)
    assert sorted(r["k"] for r in skew.keys_present(keys, table, "k").collect()) == want
