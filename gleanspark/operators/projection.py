"""Column selection: adaptive lists, public views, output contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanspark.plans.skew import lookup_join

LIST_COLUMNS = ("id", "url", "title", "publish_time")

# The columns each public view shows.
PUBLIC_COLUMNS = {
    "config": ("id", "name", "created_at"),
    "query": ("id", "name", "sql", "created_at"),
    "task": (
        "task_group", "task_name", "task_content", "source_platform", "id",
        "task_fingerprint", "status", "is_delete", "created_at", "updated_at",
    ),
    "user": ("email", "is_active", "is_superuser", "full_name", "id", "created_at"),
    "row": LIST_COLUMNS,
    "detail": ("id", "url", "cover_url", "title", "description", "author", "publish_time", "content"),
}

ROW_CONTRACT = {"id": "bigint", "url": "string", "title": "string", "publish_time": "timestamp"}
DETAIL_CONTRACT = {
    "id": "bigint",
    "url": "string",
    "cover_url": "string",
    "title": "string",
    "description": "string",
    "author": "string",
    "publish_time": "timestamp",
    "content": "string",
}


def adaptive_select(df: DataFrame, wanted: Sequence[str] = LIST_COLUMNS) -> DataFrame:
    """The wanted columns the table has, in wanted order; all columns if it has none.

    Decided while planning, so the scan reads only the chosen columns.
    """
    chosen = [c for c in wanted if c in df.columns]
    return df.select(*chosen) if chosen else df


def public_view(df: DataFrame, kind: str) -> DataFrame:
    """The columns of ``kind`` that may leave the system."""
    return df.select(*PUBLIC_COLUMNS[kind])


def id_first(df: DataFrame, key: str = "id") -> DataFrame:
    """``id`` first, the other columns in their own order."""
    return df.select(key, *[c for c in df.columns if c != key])


def record_detail(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Full rows of the requested ids."""
    wanted = ids.select(key).distinct()
    return lookup_join(df, wanted, key, "left_semi", unique=True).select(*df.columns)


def _cast_and_fault(df: DataFrame, name: str, want: str) -> tuple[Column, Column]:
    """The column in the contract's type, and what is wrong with it (NULL if nothing)."""
    if name not in df.columns:
        return F.lit(None).cast(want), F.lit(f"{name}: missing column")
    value, held = F.col(f"`{name}`"), df.schema[name].dataType
    if want == "string" and not isinstance(held, T.StringType):
        # a number is not accepted where text is due
        return F.lit(None).cast(want), F.lit(f"{name}: wrong type")
    if want == "timestamp" and isinstance(held, T.TimestampNTZType):
        want = "timestamp_ntz"
    cast = value if held.simpleString() == want else value.try_cast(want)
    wrong = value.isNotNull() & cast.isNull()
    if want == "bigint" and isinstance(held, (T.DoubleType, T.FloatType, T.DecimalType)):
        wrong = wrong | (value != F.floor(value))
    fault = F.when(value.isNull(), F.lit(f"{name}: null")).when(wrong, F.lit(f"{name}: wrong type"))
    return cast, fault


def enforce_contract(df: DataFrame, contract: dict[str, str] | None = None, on_error: str = "fail"):
    """Hold rows to a contract: the listed columns, in their types, none NULL.

    ``fail`` returns the conforming frame and lets one bad row fail the job, as one bad row
    fails a response. ``split`` returns (conforming rows, rejects), the rejects being the
    rows as they came plus ``reason``.
    """
    contract = contract or ROW_CONTRACT
    checked = {name: _cast_and_fault(df, name, want) for name, want in contract.items()}
    reason = F.concat_ws("; ", *[fault for _, fault in checked.values()])
    shaped = [cast.alias(name) for name, (cast, _) in checked.items()]
    if on_error == "fail":
        held = F.assert_true(reason == "", F.concat(F.lit("contract violated: "), reason)).isNull()
        return df.where(held).select(*shaped)
    if on_error == "split":
        return df.where(reason == "").select(*shaped), df.withColumn("reason", reason).where(F.col("reason") != "")
    raise ValueError(f"unknown on_error {on_error!r}")
