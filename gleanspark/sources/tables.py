"""Reading and writing tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from gleanspark.sources.schemas import SCHEMAS

_NAME = re.compile(r"^[A-Za-z0-9_]+$")
MISSING = {"PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"}


class TableNotFound(LookupError):
    """The registry names a table that does not exist (404)."""


class TableUnreadable(RuntimeError):
    """The table exists but cannot be loaded (400)."""


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A metadata table ``root/name.parquet`` in its declared layout.

    The declared columns are taken by name, so files with more columns or another order read
    the same, and the scan touches only what a query uses.
    """
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def scan_dynamic(spark: SparkSession, root: str, table_name: str) -> DataFrame:
    """An article table, its layout taken from the files or the catalog."""
    if not _NAME.match(table_name or ""):
        raise TableNotFound(f"Table '{table_name}' not found")
    try:
        if spark.catalog.tableExists(table_name):
            return spark.table(table_name)
        return spark.read.parquet(f"{root}/{table_name}.parquet")
    except AnalysisException as fault:
        if fault.getCondition() in MISSING:
            raise TableNotFound(f"Table '{table_name}' not found") from fault
        raise TableUnreadable(f"Error loading table: {fault}") from fault


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of a SQL database, read in parallel over ranges of ``key``.

    ``lower`` and ``upper`` place the ranges and drop no rows.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=key,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
    )
    return reader.options(**(properties or {})).load()


def append_jdbc(new_rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Add rows to a table of a SQL database, one connection per partition."""
    writer = new_rows.write.format("jdbc").options(url=url, dbtable=table).options(**(properties or {}))
    writer.mode("append").save()


def append_rows(base: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The table with rows added; the new rows are brought to its column types."""
    typed = [new_rows[f.name].cast(f.dataType).alias(f.name) for f in base.schema]
    return base.unionByName(new_rows.select(*typed))


def write_append(new_rows: DataFrame, path: str) -> None:
    """Add rows to a stored table without reading it."""
    new_rows.write.mode("append").parquet(path)


def write_state(state: DataFrame, path: str, cluster_by: str | None = None) -> None:
    """Store a new table state at a path that does not exist yet.

    A state is computed from the previous one, so it never replaces the files it reads.
    ``cluster_by`` sorts the files by a lookup column, so that row-group statistics let
    later key lookups skip most of them.
    """
    if cluster_by is not None:
        state = state.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    state.write.mode("errorifexists").parquet(path)
