"""Deep pages of a stored table by a counted index of its key ranges.

The table is stored range-sorted by a page order. The index has one row per file: the first
position of its rows and their number. A page at any depth reads only the files that
hold its positions; the index is as long as the table has files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.operators.paging import Order, check_page

ROWS = "rows"
INDEX = "index"
TASK_ROWS = 100_000  # rows that one task sorts and writes, into as many files as they ask for


def write_positions(df: DataFrame, path: str, order: Sequence[Order], rows_per_file: int = 1_000_000) -> None:
    """Store ``df`` in page order at a path that does not exist yet, with its index beside it.

    The order should end in a key, as of rows equal in all its columns any may come first; they
    may also stand in any one order on every page, as the stored order does not change. An empty
    table gets an empty index.
    """
    if rows_per_file < 1:
        raise ValueError("rows_per_file must be at least 1")
    spark = df.sparkSession
    columns = [part.column() for part in order]
    # each task reports to the driver, and the more ranges, the more rows are sampled there
    tasks = max(1, -(-df.count() // max(rows_per_file, TASK_ROWS)))
    placed = df.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns)
    placed.write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(f"{path}/{ROWS}")
    stored = spark.read.schema(df.schema).parquet(f"{path}/{ROWS}")
    # part files are named in the order of their range partitions, and of their rows in one partition
    counted = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    number = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("bigint")
    piece = F.coalesce(F.regexp_extract("file", r"c(\d+)\.[^-]*$", 1).try_cast("bigint"), F.lit(0))
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    index = counted.select("file", "rows", number.alias("part"), piece.alias("piece")).withColumn(
        "start", F.coalesce(F.sum("rows").over(before), F.lit(0))
    )
    index.select("file", "start", "rows").coalesce(1).write.mode("errorifexists").parquet(f"{path}/{INDEX}")


def positions_total(spark: SparkSession, path: str) -> DataFrame:
    """One row: the number of rows stored, from the index alone."""
    index = spark.read.schema("file string, start bigint, rows bigint").parquet(f"{path}/{INDEX}")
    return index.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_count"))


def page_at(spark: SparkSession, path: str, order: Sequence[Order], skip: int, limit: int) -> DataFrame:
    """Rows ``skip .. skip+limit`` of a table stored by ``write_positions`` under the same order.

    Files that hold none of these positions are not opened.
    """
    check_page(skip, limit)
    index = spark.read.schema("file string, start bigint, rows bigint").parquet(f"{path}/{INDEX}")
    wanted = (F.col("start") < skip + limit) & (F.col("start") + F.col("rows") > skip)
    held = index.where(wanted).orderBy("start").collect()
    if not held or not limit:
        return spark.read.parquet(f"{path}/{ROWS}").limit(0)
    some = spark.read.parquet(*[f"{path}/{ROWS}/{r['file']}" for r in held])
    return some.orderBy(*[part.column() for part in order]).offset(skip - held[0]["start"]).limit(limit)
