"""The registry of article tables and the stored queries on them."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.filters import enabled_only, where_key
from gleanspark.operators.paging import page_desc, total_of
from gleanspark.operators.projection import public_view
from gleanspark.sources.tables import MISSING, TableNotFound, scan_dynamic


def list_sources(configs: DataFrame, skip: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(page of enabled registry entries, newest first; one-row count of enabled entries)."""
    enabled = enabled_only(configs)
    page = page_desc(enabled, "created_at", skip, limit, nulls="first")
    return public_view(page, "config"), total_of(enabled)


def _one_row(df: DataFrame, what: str):
    """The single row of a key lookup: at most two rows reach the driver."""
    rows = df.take(2)
    if len(rows) != 1:
        raise LookupError(f"{what}: {'no row' if not rows else 'more than one row'}")
    return rows[0]


def resolve_table_name(configs: DataFrame, config_id) -> str:
    """Table name of a registry entry, enabled or not."""
    return _one_row(where_key(configs, "id", config_id).select("table_name"), f"config {config_id}")["table_name"]


def resolve_source(spark: SparkSession, configs: DataFrame, config_id, root: str) -> DataFrame:
    """The article table a registry entry names."""
    return scan_dynamic(spark, root, resolve_table_name(configs, config_id))


def reflect_schema(df: DataFrame) -> DataFrame:
    """Columns of a table: ordinal, name, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean")


def list_saved_queries(
    queries: DataFrame, config_id, skip: int = 0, limit: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(page of one entry's stored queries, newest first; one-row count of them)."""
    own = where_key(queries, "config_id", config_id)
    return public_view(page_desc(own, "created_at", skip, limit, nulls="first"), "query"), total_of(own)


def run_sql(spark: SparkSession, sql: str, ahead: str = "") -> DataFrame:
    """Run SQL text as a query over the session's tables and views.

    The text stands inside a SELECT, so statements that write or define anything do not parse. ``ahead`` is put before that SELECT.
    """
    body = sql.strip()
    while body.endswith(";"):
        body = body[:-1].rstrip()
    return spark.sql(f"{ahead}SELECT * FROM (\n{body}\n) q")


def run_saved_query(spark: SparkSession, queries: DataFrame, sql_id) -> DataFrame:
    """Full result of a stored query."""
    stored = _one_row(where_key(queries, "id", sql_id).select("sql"), f"query {sql_id}")
    return run_sql(spark, stored["sql"])


# Comments and quoted text, which name no table.
_ASIDE = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", re.DOTALL)
_NAME = re.compile(r"[A-Za-z0-9_]+")


def _names_in(sql: str) -> list[str]:
    """Every word of the text that may name a table, in lower case."""
    return sorted({name.lower() for name in _NAME.findall(_ASIDE.sub(" ", sql))})


def run_registered_query(spark: SparkSession, configs: DataFrame, queries: DataFrame, sql_id, root: str) -> DataFrame:
    """Full result of a stored query over the tables of enabled registry entries.

    The registry is asked only for words of the text, so what comes to the driver is bounded by
    the text. Each table found stands as a common table expression over its files in ``root``,
    for this query alone, ahead of a view of that name; nothing is registered in the session.
    Entries that are not enabled name nothing here. A registered table without files is
    ``TableNotFound``; a statement that is no query does not parse.
    """
    text = _one_row(where_key(queries, "id", sql_id).select("sql"), f"query {sql_id}")["sql"]
    known = enabled_only(configs).select("table_name").where(F.lower("table_name").isin(_names_in(text))).distinct()
    tables = {}
    for row in known.orderBy("table_name").collect():
        path = f"{root}/{row['table_name']}.parquet".replace("`", "``")
        tables.setdefault(row["table_name"].lower(), f"`{row['table_name']}` AS (SELECT * FROM parquet.`{path}`)")
    try:
        return run_sql(spark, text, f"WITH {', '.join(tables.values())} " if tables else "")
    except AnalysisException as fault:
        if fault.getCondition() in MISSING:
            raise TableNotFound(f"query {sql_id}: {fault}") from fault
        raise


def enabled_rows(spark: SparkSession, configs: DataFrame, root: str) -> DataFrame:
    """One row, ``rows_collected``: the rows of all tables that enabled entries name, each once.

    One scan counts all of them from file footers, whatever their layouts; only the distinct
    table names come to the driver. A named table without files is ``TableNotFound``.
    """
    names = [r["table_name"] for r in enabled_only(configs).select("table_name").distinct().collect() if r["table_name"]]
    if not names:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("rows_collected"))
    reader = spark.read.schema("__none string").option("recursiveFileLookup", "true")
    try:
        rows = reader.parquet(*[f"{root}/{name}.parquet" for name in names])
    except AnalysisException as fault:
        if fault.getCondition() in MISSING:
            raise TableNotFound(f"A registered table was not found: {fault}") from fault
        raise
    return total_of(rows, "rows_collected")
