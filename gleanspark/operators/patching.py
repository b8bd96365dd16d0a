"""Partial patches: only the fields a request carries change."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.access import NOT_FOUND, OK, SERVER_ERROR
from gleanspark.plans.durable import settle
from gleanspark.plans.skew import keys_present, lookup_join

TASK_PATCH_FIELDS = ("task_group", "task_name", "is_delete")


class Patched(NamedTuple):
    """New table state and one outcome per request."""

    state: DataFrame
    outcomes: DataFrame


def _merged(patches: DataFrame, fields: Sequence[str], key: str, seq: str) -> DataFrame:
    """All patches of a key as one: per field, the last patch that carries it."""
    merged = []
    for name in fields:
        carried = F.array_contains("present", name)
        merged.append(F.max_by(name, F.when(carried, F.col(seq))).alias(f"__new_{name}"))
        merged.append(F.bool_or(carried).alias(f"__set_{name}"))
    return patches.groupBy(key).agg(*merged)


def apply_patches(
    base: DataFrame, patches: DataFrame, fields: Sequence[str], key: str = "id", seq: str = "seq"
) -> DataFrame:
    """Base rows with their accepted patches applied in ``seq`` order."""
    changes = settle(_merged(patches, fields, key, seq))
    joined = lookup_join(base, changes, key, unique=True)
    columns = []
    for name in base.columns:
        if name in fields:
            new = F.col(f"__new_{name}").cast(base.schema[name].dataType)
            columns.append(F.when(F.col(f"__set_{name}"), new).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def null_fault(fields: Sequence[str]):
    """Reason text for an explicit null in a field that must not be NULL."""
    fault = F.lit(None).cast("string")
    for name in reversed(list(fields)):
        nulled = F.array_contains("present", name) & F.col(name).isNull()
        fault = F.when(nulled, F.lit(f"null in {name}")).otherwise(fault)
    return fault


def patch_rows(
    base: DataFrame,
    patches: DataFrame,
    fields: Sequence[str] = TASK_PATCH_FIELDS,
    not_null: Sequence[str] | None = None,
    key: str = "id",
    seq: str = "seq",
) -> Patched:
    """Apply a batch of partial patches.

    A patch row has ``seq``, the key, the fields and ``present``, the names of the fields the
    request carries: an absent field is left alone, an explicit null is written, unless the
    field is in ``not_null``, which refuses the request. The result equals applying the
    patches one by one in ``seq`` order.
    """
    required = fields if not_null is None else not_null
    known = keys_present(patches, base, key).withColumn("__known", F.lit(True))
    decided = settle(
        lookup_join(patches, known, key)
        .withColumn("__fault", null_fault(required))
        .withColumn(
            "outcome",
            F.when(F.col("__known").isNull(), F.lit(NOT_FOUND))
            .when(F.col("__fault").isNotNull(), F.lit(SERVER_ERROR))
            .otherwise(F.lit(OK)),
        )
        .withColumn("reason", F.when(F.col("__known").isNull(), F.lit("not found")).otherwise(F.col("__fault")))
        .drop("__known", "__fault")
    )
    state = apply_patches(base, decided.where(F.col("outcome") == OK), fields, key, seq)
    return Patched(state, decided.select(seq, key, "outcome", "reason"))
