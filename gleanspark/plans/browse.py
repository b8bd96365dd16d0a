"""The console's read paths, end to end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from gleanspark.functions.content import flatten_content
from gleanspark.operators.paging import page_adaptive, page_desc, total_of
from gleanspark.operators.projection import (
    DETAIL_CONTRACT,
    ROW_CONTRACT,
    adaptive_select,
    enforce_contract,
    id_first,
    public_view,
    record_detail,
)
from gleanspark.sources.registry import resolve_source, run_saved_query


class Page(NamedTuple):
    """Rows shown and the one-row count of all rows."""

    rows: DataFrame
    total: DataFrame


def browse(table: DataFrame, skip: int = 0, limit: int = 100) -> Page:
    """A page of an article table: the list columns it has, newest first if it has a time."""
    total = total_of(table)
    page = page_adaptive(table, "publish_time", skip, limit)
    return Page(adaptive_select(page), total)


def browse_source(
    spark: SparkSession, configs: DataFrame, config_id, root: str, skip: int = 0, limit: int = 100
) -> Page:
    """``browse`` of a registered table, held to the list contract, ``id`` first."""
    page = browse(resolve_source(spark, configs, config_id, root), skip, limit)
    return Page(id_first(enforce_contract(page.rows, ROW_CONTRACT)), page.total)


def list_table(table: DataFrame, kind: str, skip: int = 0, limit: int = 100) -> Page:
    """A page of a metadata table as its public view (``task``, ``user``), newest first, rows
    without a time before all others."""
    page = page_desc(table, "created_at", skip, limit, nulls="first")
    return Page(public_view(page, kind), total_of(table))


def run_and_count(spark: SparkSession, queries: DataFrame, sql_id) -> Page:
    """A stored query's rows under the list contract, and their number."""
    result = run_saved_query(spark, queries, sql_id)
    return Page(enforce_contract(result, ROW_CONTRACT), total_of(result))


def read_details(table: DataFrame, ids: DataFrame, on_error: str = "split"):
    """Detail rows of the asked ids with their content flattened.

    Returns what ``enforce_contract`` returns; content of a bad shape is NULL and so a reject.
    """
    rows = flatten_content(record_detail(table, ids))
    return enforce_contract(rows, DETAIL_CONTRACT, on_error)
