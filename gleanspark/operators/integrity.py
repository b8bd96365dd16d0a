"""Constraint reports and ingest defaults."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.plans.skew import keys_present, lookup_join


def _is_email(value: Column) -> Column:
    """One ``@`` with something before it, then names parted by single dots, at least two, and no
    white space. Only plain searches, so that no text is too long for the matcher."""
    host = F.substring_index(value, "@", -1)
    return (
        ~value.rlike(r"\s")
        & (F.length(F.translate(value, "@", "")) == F.length(value) - 1)
        & ~value.startswith("@")
        & host.contains(".")
        & ~(host.startswith(".") | host.endswith(".") | host.contains(".."))
    )


def orphan_tasks(tasks: DataFrame, users: DataFrame) -> DataFrame:
    """Tasks whose owner does not exist."""
    owners = users.select(F.col("id").alias("user_id"))
    return lookup_join(tasks, owners, "user_id", "left_anti").select(*tasks.columns)


def orphan_queries(queries: DataFrame, configs: DataFrame) -> DataFrame:
    """Stored queries whose registry entry does not exist."""
    known = configs.select(F.col("id").alias("config_id"))
    return lookup_join(queries, known, "config_id", "left_anti").select(*queries.columns)


def exists_in(requests: DataFrame, table: DataFrame, keys: str | Sequence[str], out: str = "already_exists") -> DataFrame:
    """Flag the requests whose key is in the table."""
    names = [keys] if isinstance(keys, str) else list(keys)
    present = keys_present(requests, table, names).withColumn(out, F.lit(True))
    flagged = lookup_join(requests, present, names)
    return flagged.withColumn(out, F.coalesce(out, F.lit(False))).select(*requests.columns, out)


def email_conflicts(patches: DataFrame, users: DataFrame) -> DataFrame:
    """Patches asking for an email another id already has. No email asked, no conflict."""
    holders = users.select("email", F.col("id").alias("holder_id"))
    asked = patches.where(F.col("email") != "")
    return (
        lookup_join(asked, holders, "email", "inner")
        .where(F.col("holder_id") != F.col("id"))
        .select(*patches.columns, "holder_id")
    )


def unique_violations(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Values of a unique key that occur more than once, and how often."""
    names = [key] if isinstance(key, str) else list(key)
    return (
        df.dropna("any", subset=names)
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


@dataclass(frozen=True)
class FieldRule:
    """What a column must satisfy. Lengths count characters."""

    max_length: int | None = None
    required: bool = False
    email: bool = False


# The declared limits of each table's columns.
TASK_RULES = {
    "task_group": FieldRule(100, True),
    "task_name": FieldRule(200, True),
    "task_content": FieldRule(None, True),
    "source_platform": FieldRule(50, True),
    "task_fingerprint": FieldRule(32, True),
    "status": FieldRule(None, True),
    "is_delete": FieldRule(None, True),
    "user_id": FieldRule(None, True),
}
RUN_RULES = {
    "task_fingerprint": FieldRule(32, True),
    "source_platform": FieldRule(50, True),
    "priority": FieldRule(None, True),
    "cron_expr": FieldRule(50, True),
    "crawl_task": FieldRule(None, True),
    "status": FieldRule(None, True),
    "enabled": FieldRule(None, True),
}
CONFIG_RULES = {
    "name": FieldRule(50, True),
    "db_name": FieldRule(50, True),
    "table_name": FieldRule(50, True),
    "db_uri": FieldRule(500),
    "enabled": FieldRule(None, True),
}
QUERY_RULES = {
    "name": FieldRule(50, True),
    "sql": FieldRule(1000, True),
    "config_id": FieldRule(None, True),
    "enabled": FieldRule(None, True),
}
USER_RULES = {
    "email": FieldRule(255, True, True),
    "full_name": FieldRule(255),
    "hashed_password": FieldRule(None, True),
    "is_active": FieldRule(None, True),
    "is_superuser": FieldRule(None, True),
}


def field_violations(df: DataFrame, rules: dict[str, FieldRule], key: str = "id") -> DataFrame:
    """One row per broken rule: key, ``field``, ``rule`` (null, too_long, not_email).

    All rules are tested in one pass over the rows; columns the table lacks are skipped.
    """
    broken: list[Column] = []
    for name, rule in rules.items():
        if name not in df.columns:
            continue
        value = F.col(name)
        tests = []
        if rule.required:
            tests.append((value.isNull(), "null"))
        if rule.max_length is not None:
            tests.append((F.length(value) > rule.max_length, "too_long"))
        if rule.email:
            tests.append((~_is_email(value), "not_email"))
        broken += [F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(what).alias("rule"))) for bad, what in tests]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("__b")).select(key, "__b.field", "__b.rule")


# Column defaults on ingest.
TASK_DEFAULTS = {
    "task_group": "default group",
    "task_name": "default name",
    "task_content": "{}",
    "source_platform": "",
    "status": 0,
    "is_delete": False,
}
RUN_DEFAULTS = {
    "source_platform": "",
    "priority": 5,
    "cron_expr": "",
    "crawl_task": "{}",
    "status": 0,
    "enabled": False,
}
USER_DEFAULTS = {"is_active": True, "is_superuser": False, "full_name": None}
CONFIG_DEFAULTS = {"name": "", "db_name": "", "table_name": "", "db_uri": "", "enabled": False}
QUERY_DEFAULTS = {"name": "", "sql": "", "enabled": False}
_SMALL = {"status", "priority"}


def row_id(*parts: Column | str) -> Column:
    """A UUID-shaped id computed from the row, so a recomputed task gives the same id."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.regexp_replace(
        F.md5(F.concat_ws("\x1f", *text)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def apply_defaults(
    df: DataFrame,
    spec: dict[str, object],
    timestamps: Sequence[str] = (),
    now: Column | None = None,
    id_from: Sequence[str] = (),
) -> DataFrame:
    """Add the columns a request left out: constants, times of ingest and the id.

    Only *absent* columns are filled; a NULL that was sent stays. ``now`` fixes one time for
    the batch, ``id_from`` names the columns the id is derived from.
    """
    for name, value in spec.items():
        if name not in df.columns:
            default = F.lit(value)
            if value is None:
                default = default.cast("string")
            elif name in _SMALL:
                default = default.cast("smallint")
            df = df.withColumn(name, default)
    for name in timestamps:
        if name not in df.columns:
            df = df.withColumn(name, F.current_timestamp() if now is None else now)
    if id_from and "id" not in df.columns:
        df = df.withColumn("id", row_id(*id_from))
    return df
