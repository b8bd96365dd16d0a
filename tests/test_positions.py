import uuid

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from gleanspark.operators.paging import newest_order
from gleanspark.plans.durable import checkpoint_folder
from gleanspark.plans.positions import INDEX, ROWS, page_at, positions_total, write_positions
from gleanspark.sources import registry
from gleanspark.sources.tables import TableNotFound
from tests.conftest import SMALL

ORDER = newest_order("at", "id", "first")


def stored(spark, rows, per_file):
    path = f"{checkpoint_folder(spark)}/positions-{uuid.uuid4().hex}"
    write_positions(rows, path, ORDER, per_file)
    return path


def test_pages_at_any_depth_open_only_their_files(spark):
    # a third of the rows has one time, some have none
    at = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 != 1, F.col("id") * 7919 % 1009).cast("bigint")
    rows = spark.range(2000).select("id", at.alias("at"))
    path = stored(spark, rows, 50)
    want = [r.id for r in rows.orderBy(*[o.column() for o in ORDER]).collect()]
    assert positions_total(spark, path).first()[0] == 2000
    for skip, limit in ((0, 10), (49, 2), (1234, 30), (1990, 100), (2000, 5), (5, 0), (300, 400)):
        page = page_at(spark, path, ORDER, skip, limit)
        assert [r.id for r in page.collect()] == want[skip : skip + limit], (skip, limit)
    index = spark.read.parquet(f"{path}/{INDEX}")
    assert index.agg(F.max("rows")).first()[0] <= 50
    opened = page_at(spark, path, ORDER, 1234, 30).inputFiles()
    held = spark.read.parquet(*opened).count()
    assert held <= 2000 * 0.05 and len(spark.read.parquet(f"{path}/{ROWS}").inputFiles()) >= 40


def test_positions_of_an_empty_table(spark):
    path = stored(spark, spark.createDataFrame([], "id long, at long"), 10)
    assert positions_total(spark, path).first()[0] == 0
    assert page_at(spark, path, ORDER, 0, 10).count() == 0


def asked(spark, text, enabled=True, name="nation"):
    configs = spark.createDataFrame([(1, name, enabled), (2, "region", True)], "id long, table_name string, enabled boolean")
    queries = spark.createDataFrame([(1, text)], "id long, sql string")
    return registry.run_registered_query(spark, configs, queries, 1, SMALL)


def test_stored_text_over_registered_tables(spark):
    text = "WITH few AS (SELECT * FROM Nation) SELECT count(*) AS n FROM few JOIN `region` ON n_regionkey = r_regionkey;"
    spark.range(1).createOrReplaceTempView("region")  # the registered table goes first
    try:
        assert asked(spark, text).first().n == spark.read.parquet(f"{SMALL}/nation.parquet").count()
    finally:
        spark.catalog.dropTempView("region")
    assert not spark.catalog.tableExists("nation")
    assert asked(spark, "SELECT 'nation' AS a -- nation").first().a == "nation"


def test_stored_text_that_is_refused(spark):
    with pytest.raises(TableNotFound):
        asked(spark, "SELECT * FROM nation", enabled=False)
    with pytest.raises(TableNotFound):
        asked(spark, "SELECT * FROM nowhere", name="nowhere")
    with pytest.raises(ParseException):
        asked(spark, "DROP TABLE nation")
    with pytest.raises(ParseException):
        asked(spark, "INSERT INTO nation SELECT * FROM nation")


def test_rows_of_enabled_tables(spark):
    rows = [(1, "nation", True), (2, "nation", True), (3, "region", True), (4, "part", False), (5, None, True)]
    configs = spark.createDataFrame(rows, "id long, table_name string, enabled boolean")
    want = sum(spark.read.parquet(f"{SMALL}/{n}.parquet").count() for n in ("nation", "region"))
    assert registry.enabled_rows(spark, configs, SMALL).first()[0] == want
    assert registry.enabled_rows(spark, configs.where("id = 4"), SMALL).first()[0] == 0
    with pytest.raises(TableNotFound):
        registry.enabled_rows(spark, configs.select("id", F.lit("nowhere").alias("table_name"), "enabled"), SMALL)
