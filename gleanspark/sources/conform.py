"""Bring data written under an older layout to the current one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the tables' history renamed.
TASK_RENAMES = {"user": "user_id"}
TABLE_RENAMES = {"taskrun": "task_run", "spiderbuilder": "rule"}
TASK_BACKFILL = {"task_name": "default name"}


def current_name(table: str) -> str:
    """The name a table goes by today."""
    return TABLE_RENAMES.get(table, table)


def conform_schema(
    df: DataFrame,
    target_schema: T.StructType,
    renames: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """The frame in the target's columns, types and order.

    ``renames`` maps old to new names and keeps the values. A column the data lacks is filled
    from ``defaults``, or NULL where the target allows it; a required column without a
    default is an error, as it is for a table that already holds rows. A column that became
    required gets the default in place of NULL. Columns the target lacks are dropped.
    """
    renames, defaults = dict(renames or {}), dict(defaults or {})
    clash = [new for old, new in renames.items() if old in df.columns and new in df.columns]
    if clash:
        raise ValueError(f"renamed columns already exist: {clash}")
    named = df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns})
    columns = []
    for field in target_schema:
        if field.name in named.columns:
            value = F.col(f"`{field.name}`")
            if field.name in defaults and not field.nullable:
                value = F.coalesce(value, F.lit(defaults[field.name]))
        elif field.name in defaults:
            value = F.lit(defaults[field.name])
        elif field.nullable:
            value = F.lit(None)
        else:
            raise ValueError(f"required column {field.name!r} is missing and has no default")
        columns.append(value.cast(field.dataType).alias(field.name))
    return named.select(*columns)
