"""Row-level access decisions, one per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.plans.skew import lookup_join

# Outcome codes and their messages.
OK, BAD_REQUEST, FORBIDDEN, NOT_FOUND, CONFLICT, SERVER_ERROR = 200, 400, 403, 404, 409, 500
TASK_NOT_FOUND = "该任务在系统中不存在"
NO_PERMISSION = "用户没有足够的权限"
NO_PERMISSION_GATE = "用户没有足够的权限。"
USER_NOT_FOUND = "用户不存在"
ACTOR_NOT_FOUND = "User not found"
ACTOR_INACTIVE = "Inactive user"


def actors(users: DataFrame, key: str = "user_id") -> DataFrame:
    """What the gate asks of whoever makes a request. Users without an ``is_active`` column are
    all active; an unknown flag is not true."""
    active = F.coalesce("is_active", F.lit(False)) if "is_active" in users.columns else F.lit(True)
    return users.select(
        F.col("id").alias(key), active.alias("actor_is_active"), F.col("is_superuser").alias("actor_is_superuser")
    )


def gate_outcome() -> Column:
    """Every request needs a known (404) and active (400) actor; NULL once it has one."""
    return F.when(F.col("actor_is_active").isNull(), F.lit(NOT_FOUND)).when(
        ~F.col("actor_is_active"), F.lit(BAD_REQUEST)
    )


def gate_reason() -> Column:
    return F.when(F.col("actor_is_active").isNull(), F.lit(ACTOR_NOT_FOUND)).when(
        ~F.col("actor_is_active"), F.lit(ACTOR_INACTIVE)
    )


def task_access(requests: DataFrame, tasks: DataFrame, users: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Decide each (``user_id``, ``task_id``) request on a task.

    An unknown actor is 404 and an inactive one 400, whatever the task. A missing task is 404; a
    task of someone else is 403 unless the actor is a superuser. Adds ``outcome`` and ``reason``, and the task columns named in ``carry``.
    """
    wanted = tasks.select(
        F.col("id").alias("task_id"),
        F.col("user_id").alias("owner_id"),
        F.lit(True).alias("task_found"),
        *[F.col(c) for c in carry],
    )
    seen = lookup_join(lookup_join(requests, wanted, "task_id"), actors(users), "user_id", keys_from=requests)
    allowed = (F.col("owner_id") == F.col("user_id")) | F.coalesce("actor_is_superuser", F.lit(False))
    return (
        seen.withColumn(
            "outcome",
            F.when(gate_outcome().isNotNull(), gate_outcome())
            .when(F.col("task_found").isNull(), F.lit(NOT_FOUND))
            .when(F.coalesce(allowed, F.lit(False)), F.lit(OK))
            .otherwise(F.lit(FORBIDDEN)),
        )
        .withColumn(
            "reason",
            F.when(gate_reason().isNotNull(), gate_reason())
            .when(F.col("outcome") == NOT_FOUND, F.lit(TASK_NOT_FOUND))
            .when(F.col("outcome") == FORBIDDEN, F.lit(NO_PERMISSION)),
        )
        .select(*requests.columns, *carry, "outcome", "reason")
    )


def user_access(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Decide each (``user_id``, ``target_id``) request to read a user.

    An unknown actor is 404 and an inactive one 400. Oneself is fine; anyone else needs a superuser, and only a superuser learns that a user
    does not exist.
    """
    targets = users.select(F.col("id").alias("target_id"), F.lit(True).alias("target_found"))
    seen = lookup_join(lookup_join(requests, targets, "target_id"), actors(users), "user_id", keys_from=requests)
    return (
        seen.withColumn(
            "outcome",
            F.when(gate_outcome().isNotNull(), gate_outcome())
            .when(F.col("target_id") == F.col("user_id"), F.lit(OK))
            .when(~F.coalesce("actor_is_superuser", F.lit(False)), F.lit(FORBIDDEN))
            .when(F.col("target_found").isNull(), F.lit(NOT_FOUND))
            .otherwise(F.lit(OK)),
        )
        .withColumn(
            "reason",
            F.when(gate_reason().isNotNull(), gate_reason())
            .when(F.col("outcome") == FORBIDDEN, F.lit(NO_PERMISSION))
            .when(F.col("outcome") == NOT_FOUND, F.lit(USER_NOT_FOUND)),
        )
        .select(*requests.columns, "outcome", "reason")
    )
