import zlib

import pytest
from pyspark.sql import functions as F

from gleanspark.llm.histogram_sort import histogram_shards, sort_key, splitters
from gleanspark.llm.queries import QUERIES
from tests.llm.cases import ROWS, no_docs, odd_docs

FOLDER = "/root/testdata/sf0.01"


def check_law(rows, shards, slack):
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r)
    assert set(held) <= set(range(shards))
    for shard in held.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    mean = sum(r["size"] for r in rows) / shards
    assert all(abs(sum(r["size"] for r in held.get(k, [])) - mean) <= slack for k in range(shards))


def test_query_keeps_its_law(spark):
    rows = QUERIES["op8_histogram_sort"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    check_law(rows, 24, max(r["size"] for r in rows) + 1)


def test_a_text_of_half_the_rows_is_cut_by_bytes(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"))
    docs = ids.withColumn("text", F.when(F.col("doc_id") % 2 == 0, "the same").otherwise(F.repeat(F.hex("doc_id"), 3)))
    rows = histogram_shards(docs, F.octet_length("text") + 8, 8).select("*", (F.octet_length("text") + 8).alias("size")).collect()
    check_law(rows, 8, 64)
    assert len({r.shard for r in rows if r.text == "the same"}) > 3


@pytest.mark.parametrize("part_bytes", [400, 1 << 20])
def test_order_and_slots_over_several_parts(spark, part_bytes):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    high, low = sort_key(F.col("text"), F.col("doc_id"))
    rows = (
        histogram_shards(docs, F.octet_length("text") + 8, 3, part_bytes=part_bytes)
        .select("*", high.alias("a"), low.alias("b"), (F.octet_length("text") + 8).alias("size"))
        .collect()
    )
    check_law(rows, 3, 60)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(r.a, r.b) for r in ordered] == sorted((r.a, r.b) for r in rows)


def test_splitters_are_the_nearest_keys(spark):
    keyed = spark.range(500).select(
        F.xxhash64(F.col("id") % 40).alias("h"), F.col("id").alias("d"), F.lit(10).cast("long").alias("size")
    )
    keys = sorted(((r.h + (1 << 63)) << 64) + r.d + (1 << 63) for r in keyed.collect())
    for k, cut in enumerate(splitters(keyed, 10, 0.0), 1):
        assert sum(key < cut for key in keys) == 50 * k


def test_odd_rows(spark):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    rows = histogram_shards(odd_docs(spark).drop("size"), size, 4).select("doc_id", "shard", "slot", size.alias("size")).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert histogram_shards(no_docs(spark), size, 4).count() == 0
