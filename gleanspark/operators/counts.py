"""Counts and collection statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.display import BEGIN, COMPLETED, FAILED, IN_PROGRESS, status_label


def count_all(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_where(df: DataFrame, condition: Column | str, name: str = "count") -> DataFrame:
    return df.where(condition).agg(F.count(F.lit(1)).alias(name))


def count_result(df: DataFrame, name: str = "count") -> DataFrame:
    """Size of a stored query's result, counted where the rows are."""
    return count_all(df, name)


def dashboard_totals(tasks: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """One row: running and completed tasks, rows collected over the sources, success rate.

    The console shows these four figures without defining them. Here running is begun or in
    progress, and the rate is completed over completed plus failed, NULL when there is neither.
    """
    rows = F.lit(0).cast("bigint")
    for source in sources:
        rows = rows + count_all(source).scalar()
    return _task_totals(tasks).withColumn("rows_collected", rows)


def _task_totals(tasks: DataFrame) -> DataFrame:
    state = F.col("status")
    done, failed = F.count_if(state == COMPLETED), F.count_if(state == FAILED)
    return tasks.agg(
        F.count_if(state.isin(BEGIN, IN_PROGRESS)).alias("running_tasks"),
        done.alias("completed_tasks"),
        F.try_divide(done.cast("double"), (done + failed).cast("double")).alias("success_rate"),
    )


def dashboard_of(tasks: DataFrame, collected: DataFrame) -> DataFrame:
    """``dashboard_totals`` with the rows counted elsewhere: ``collected`` is one row with
    ``rows_collected``, as ``registry.enabled_rows`` counts it over the enabled entries."""
    return _task_totals(tasks).withColumn("rows_collected", collected.select("rows_collected").scalar())


def platform_stats(tasks: DataFrame, articles: DataFrame, platform: str = "source_platform") -> DataFrame:
    """Tasks and collected rows per platform. Both sides are reduced to one row per platform
    before they meet."""
    per_task = tasks.groupBy(platform).agg(F.count(F.lit(1)).alias("task_count"))
    per_row = articles.groupBy(platform).agg(F.count(F.lit(1)).alias("data_count"))
    return per_task.join(per_row, platform, "full").select(
        platform,
        F.coalesce("task_count", F.lit(0)).alias("task_count"),
        F.coalesce("data_count", F.lit(0)).alias("data_count"),
    )


def tasks_by_status(tasks: DataFrame) -> DataFrame:
    """Number of tasks per status, with its label."""
    return (
        tasks.groupBy("status")
        .agg(F.count(F.lit(1)).alias("task_count"))
        .withColumn("status_label", status_label("status"))
    )
