"""Flag, key, owner and group filters, and what a principal may see in a list."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.display import BEGIN, IN_PROGRESS, KILL, PENDING
from gleanspark.operators.access import actors
from gleanspark.operators.paging import check_page, newest_first, page_desc, total_of
from gleanspark.plans.skew import SALT, SPLITS, hot_keys, lookup_join, salt_of


def enabled_only(df: DataFrame, flag: str = "enabled") -> DataFrame:
    """Rows whose flag is true; an unknown flag is not true."""
    return df.where(F.col(flag))


def where_key(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def tasks_of_owner(
    tasks: DataFrame, user_id, skip: int = 0, limit: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(page of the owner's tasks, newest first; one-row count of them)."""
    own = where_key(tasks, "user_id", user_id)
    return page_desc(own, "created_at", skip, limit, nulls="first"), total_of(own)


def _thin_hot_owners(held: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Cut owners with very many rows down to their newest ``depth`` per salt.

    What is dropped has ``depth`` newer rows of the same owner before it, so no page changes.
    """
    hot = hot_keys(held, keys)
    if hot is None:
        return held
    salted = held.join(F.broadcast(hot), keys).withColumn(SALT, salt_of(held, F.col(SPLITS))).drop(SPLITS)
    within = Window.partitionBy(*keys, SALT).orderBy(*newest_first("created_at", "id", "first"))
    thin = salted.withColumn("__rank", F.row_number().over(within)).where(F.col("__rank") <= depth)
    rest = held.join(F.broadcast(hot), keys, "left_anti")
    return rest.select(*held.columns).unionByName(thin.select(*held.columns))


def _page_per_owner(tasks: DataFrame, keys: list[str], skip: int, limit: int) -> DataFrame:
    check_page(skip, limit)
    depth = skip + limit
    held = _thin_hot_owners(tasks, keys, depth)
    ranked = Window.partitionBy(*keys).orderBy(*newest_first("created_at", "id", "first"))
    # `row_number <= depth` also lets Spark keep only that many rows per owner before the shuffle
    return (
        held.withColumn("position", F.row_number().over(ranked))
        .where((F.col("position") <= depth) & (F.col("position") > skip))
        .select(*tasks.columns, "position")
    )


def _owned_by(tasks: DataFrame, owners: DataFrame | None) -> DataFrame:
    if owners is None:
        return tasks
    return lookup_join(tasks, owners.select("user_id").distinct(), "user_id", "left_semi").select(*tasks.columns)


def tasks_of_owners(
    tasks: DataFrame, owners: DataFrame | None = None, skip: int = 0, limit: int = 100
) -> tuple[DataFrame, DataFrame]:
    """``tasks_of_owner`` for many owners at once: (their pages, their counts).

    ``owners`` None means everyone.
    """
    held = _owned_by(tasks, owners)
    counts = held.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_count"))
    return _page_per_owner(held, ["user_id"], skip, limit), counts


def tasks_of_group(
    tasks: DataFrame, user_id, group: str, skip: int = 0, limit: int = 100, count_scope: str = "all_owners"
) -> tuple[DataFrame, DataFrame]:
    """(page of the owner's tasks in a group, one-row count).

    The count covers the group over all owners, as the console has it;
    ``count_scope="owner"`` counts what is paged.
    """
    grouped = where_key(tasks, "task_group", group)
    own = where_key(grouped, "user_id", user_id)
    if count_scope not in ("all_owners", "owner"):
        raise ValueError("count_scope must be 'all_owners' or 'owner'")
    counted = grouped if count_scope == "all_owners" else own
    return page_desc(own, "created_at", skip, limit, nulls="first"), total_of(counted)


def tasks_of_groups(tasks: DataFrame, skip: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The group pages of every (owner, group), and the group counts over all owners."""
    counts = tasks.groupBy("task_group").agg(F.count(F.lit(1)).alias("total_count"))
    return _page_per_owner(tasks, ["user_id", "task_group"], skip, limit), counts


def find_by_name(tasks: DataFrame, name, user_id) -> DataFrame:
    """Tasks of one owner with this name."""
    return tasks.where((F.col("task_name") == F.lit(name)) & (F.col("user_id") == F.lit(user_id)))


def shown_to(is_superuser: Column | bool, is_delete: str = "is_delete") -> Column:
    """Soft-deleted rows are shown to superusers only."""
    allowed = is_superuser if isinstance(is_superuser, Column) else F.lit(is_superuser)
    return allowed | ~F.col(is_delete)


class Visible(NamedTuple):
    """Own pages with their ``viewer_id``, the one page all superusers share, and the superusers."""

    own: DataFrame
    shared: DataFrame
    viewers: DataFrame


def visible_tasks(
    tasks: DataFrame,
    users: DataFrame,
    skip: int = 0,
    limit: int = 100,
    after_paging: bool = True,
) -> Visible:
    """The task list each user opens.

    Superusers page through all tasks and see deleted ones; others page through their own
    and do not. Deleted rows are taken out *after* paging by default, so a page may be short.
    The superuser page is one and the same for all of them: it is given once, beside those it
    is for, and never multiplied by their number. There is no upper bound on ``limit``.
    """
    viewers = users.select(F.col("id").alias("viewer_id"), "is_superuser")
    plain = viewers.where(~F.col("is_superuser")).select(F.col("viewer_id").alias("user_id"))
    own = _owned_by(tasks if after_paging else tasks.where(~F.col("is_delete")), plain)
    pages = _page_per_owner(own, ["user_id"], skip, limit)
    mine = pages.where(~F.col("is_delete")).withColumn("viewer_id", F.col("user_id"))

    return Visible(
        mine.select("viewer_id", *tasks.columns),
        page_desc(tasks, "created_at", skip, limit, nulls="first"),
        viewers.where("is_superuser").select("viewer_id"),
    )


def allowed_actions(status: str = "status", is_delete: str = "is_delete") -> Column:
    """Actions offered for a task: start if pending or stopped, stop if begun or running,
    delete always, nothing once deleted."""
    state = F.col(status)
    actions = F.array_compact(
        F.array(
            F.when(state.isin(PENDING, KILL), F.lit("start")),
            F.when(state.isin(BEGIN, IN_PROGRESS), F.lit("stop")),
            F.lit("delete"),
        )
    )
    return F.when(F.col(is_delete), F.array().cast("array<string>")).otherwise(actions)


def superuser_only(requests: DataFrame, users: DataFrame, actor: str = "user_id") -> DataFrame:
    """The requests made by active superusers."""
    supers = actors(users, actor).where("actor_is_superuser AND actor_is_active").select(actor)
    return lookup_join(requests, supers, actor, "left_semi").select(*requests.columns)
