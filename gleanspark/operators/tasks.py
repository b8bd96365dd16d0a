"""Task admission and the task life cycle, over batches of requests.

Each operator takes a batch of requests with a unique ``seq`` and returns the new state of
the tables it changes together with one outcome per request. Decisions are settled once, so
state and outcomes always agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.content import compact_json, missing_fields, project_content, rule_keys
from gleanspark.functions.display import (
    BEGIN,
    KILL,
    PENDING,
    duplicate_name_message,
    duplicate_task_message,
)
from gleanspark.functions.hashing import task_fingerprint
from gleanspark.operators.access import BAD_REQUEST, OK, SERVER_ERROR, task_access
from gleanspark.operators.integrity import TASK_DEFAULTS, apply_defaults, row_id
from gleanspark.operators.paging import last_per_key
from gleanspark.operators.patching import TASK_PATCH_FIELDS, Patched, apply_patches, null_fault
from gleanspark.plans.durable import settle, written
from gleanspark.plans.ordered import by_components, one_pass, pass_limit
from gleanspark.plans.skew import keys_present, lookup_join, shuffle_join
from gleanspark.sources.schemas import RUN_COLUMNS, TASK_COLUMNS

# The longest text a field of a new task may hold.
MOST_CHARACTERS = {"task_group": 100, "task_name": 200, "source_platform": 50}
RULE_FAULT = "抓取规则设置错误"
NO_RUN = "no_run"


# --- joins ---------------------------------------------------------------------------------


def tasks_with_rule(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Each task with its platform's crawl rule and a ``rule_status``: ``ok``, ``no_rule`` or
    ``empty_content``."""
    by_platform = rules.select("source_platform", "crawl_rule")
    empty = F.coalesce(F.regexp_replace("task_content", r"\s", ""), F.lit("")).isin("", "{}", "null")
    return (
        lookup_join(tasks, by_platform, "source_platform")
        .withColumn(
            "rule_status",
            F.when(F.col("crawl_rule").isNull(), F.lit("no_rule"))
            .when(empty, F.lit("empty_content"))
            .otherwise(F.lit("ok")),
        )
        .select(*tasks.columns, "crawl_rule", "rule_status")
    )


def tasks_with_run(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Each task with its run's id, status and flags; NULL where it was never begun."""
    run = runs.select(
        "task_fingerprint",
        F.col("id").alias("run_id"),
        F.col("status").alias("run_status"),
        F.col("priority").alias("run_priority"),
        F.col("error_reason").alias("run_error_reason"),
    )
    return lookup_join(tasks, run, "task_fingerprint", unique=True).select(*tasks.columns, *run.columns[1:])


def rows_with_keys(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows of a table, unique on its key, whose key is asked for."""
    return lookup_join(table, keys, on, "left_semi", unique=True).select(*table.columns)


# --- admission -----------------------------------------------------------------------------


class Admission(NamedTuple):
    """Accepted task rows, rejected requests with reason, and one outcome per request."""

    accepted: DataFrame
    rejected: DataFrame
    outcomes: DataFrame


_NAME = ["user_id", "task_name"]
_FP = "task_fingerprint"


def _first_come():
    """An ordered pass: whoever comes first takes the fingerprint and the name."""

    # nested, so that it travels to the workers by value
    def decide(rows):
        prints, names, kept = set(), set(), []
        for print_, user, name in zip(rows["task_fingerprint"], rows["user_id"], rows["task_name"], strict=True):
            free = print_ not in prints and (user, name) not in names
            if free:
                prints.add(print_)
                names.add((user, name))
            kept.append(free)
        return rows[kept]

    return decide


def _round(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests admitted for certain, and those that are still open.

    A request that comes first in both its groups, same fingerprint and same owner and name, is
    admitted, and everything sharing a key with it is refused. All such requests are settled
    at once, in one stored frame that marks both. Every group is reduced to its smallest ``seq``
    before the shuffle, and no group is ever gathered.
    """
    columns = undecided.columns
    first_of_print = undecided.groupBy(_FP).agg(F.min("seq").alias("seq"))
    first_of_name = undecided.groupBy(*_NAME).agg(F.min("seq").alias("seq"))
    winners = shuffle_join(first_of_print, first_of_name, "seq")
    by_print = winners.select(_FP, F.col("seq").alias("print_winner"))
    by_name = winners.select(*_NAME, F.col("seq").alias("name_winner"))
    marked = written(
        shuffle_join(shuffle_join(undecided, by_print, _FP, "left"), by_name, _NAME, "left").select(
            *columns,
            F.coalesce((F.col("seq") == F.col("print_winner")) & (F.col("seq") == F.col("name_winner")), F.lit(False)).alias("won"),
            (F.col("print_winner").isNull() & F.col("name_winner").isNull()).alias("open"),
        )
    )
    return marked.where("won").select(*columns), marked.where("open").select(*columns)


def _greedy(undecided: DataFrame) -> DataFrame:
    """Requests a one-by-one pass in ``seq`` order would admit.

    Up to ``gleanspark.ordered.maxRows`` are passed over as they are. Of more, rounds settle the
    heads of all groups and with them most of what hot keys hold; after three of them, or one that
    left more than three quarters open, the components of shared keys are taken apart, small ones
    passed over in bundles, so a long chain costs no round for each link. Components above the
    limit go through further rounds, all of them, twice as many each time.
    """
    limit, rounds = pass_limit(undecided.sparkSession), 3
    links = F.array(F.xxhash64(F.lit("print"), _FP), F.xxhash64(F.lit("name"), *_NAME))
    won: list[DataFrame] = []
    whole = True
    while True:
        before = None
        for _ in range(rounds):
            count = undecided.count()
            if limit and whole and before and count * 4 > before * 3:
                break
            before = count
            if count <= limit:
                if count:
                    won.append(one_pass(undecided, _first_come(), undecided.schema))
                return written(_union(won or [undecided]))
            certain, undecided = _round(undecided)
            won.append(certain)
            if len(won) > 8:
                won = [written(_union(won))]
        if limit:
            decided, undecided = by_components(undecided, links, _first_come(), undecided.schema)
            won.append(decided)
        rounds, whole = rounds * 2, False


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _field_fault(requests: DataFrame) -> Column:
    """What a request's own fields have wrong with them, NULL if nothing."""
    faults = []
    for name in ("task_group", "task_name", "task_content", "source_platform"):
        if name not in requests.columns:
            continue
        if "present" in requests.columns:
            sent = F.coalesce(F.array_contains("present", name), F.lit(False))
            faults.append(F.when(sent & F.col(name).isNull(), F.lit(f"{name} is null")))
        if name in MOST_CHARACTERS:
            faults.append(F.when(F.length(name) > MOST_CHARACTERS[name], F.lit(f"{name} is too long")))
    return F.coalesce(*faults, F.lit(None).cast("string"))


def admit_tasks(requests: DataFrame, tasks: DataFrame, now: Column | None = None, mode: str = "exact") -> Admission:
    """Admit new tasks in ``seq`` order.

    A request is refused if a task with its fingerprint exists, whoever owns it and deleted
    or not; else if its owner already has a task of that name; else it becomes a pending
    task. Requests of the batch count as existing tasks once admitted, and a refused request
    does not occupy its name. Fields a request leaves out take their defaults. Content that is no
    JSON, a text longer than its field, and, where requests say by ``present`` what they carry, a
    NULL that was sent are refused before anything else.
    """
    filled = apply_defaults(requests.withColumn("fault", _field_fault(requests)), TASK_DEFAULTS)
    for name in ("task_group", "task_name", "task_content", "source_platform"):
        filled = filled.withColumn(name, F.coalesce(name, F.lit(TASK_DEFAULTS[name])))
    printed = task_fingerprint(filled, mode)
    no_json = F.when(F.col(_FP).isNull(), F.lit("task_content is no JSON"))
    staged = settle(printed.select("seq", _FP, *_NAME, "task_group", F.coalesce("fault", no_json).alias("fault")))

    # same fingerprint, owner and name: only the earliest can be admitted
    sound = staged.where("user_id IS NOT NULL AND fault IS NULL")
    distinct = sound.groupBy(_FP, *_NAME).agg(F.min("seq").alias("seq"))
    distinct = settle(distinct.select("seq", _FP, *_NAME))
    held = settle(
        rows_with_keys(distinct.select(_FP).distinct(), tasks.select(_FP, "task_group", "task_name"), _FP)
        .groupBy(_FP)
        .agg(F.min(F.struct("task_group", "task_name")).alias("holder"))
    )
    names_taken = keys_present(distinct, tasks, _NAME)
    open_requests = lookup_join(distinct, held.select(_FP), _FP, "left_anti")
    open_requests = lookup_join(open_requests, names_taken, _NAME, "left_anti")
    admitted = _greedy(written(open_requests.select(*distinct.columns)))

    admitted_seq = admitted.select("seq").withColumn("admitted", F.lit(True))
    marked = lookup_join(staged, admitted_seq, "seq", unique=True).select(*staged.columns, "admitted")
    # the task that holds a fingerprint: an existing one, or the one admitted in this batch
    in_batch = marked.where("admitted").select(
        _FP, F.struct("task_group", "task_name").alias("holder"), F.col("seq").alias("holder_seq")
    )
    holders = held.withColumn("holder_seq", F.lit(None).cast(in_batch.schema["holder_seq"].dataType)).unionByName(in_batch)
    judged = lookup_join(marked, settle(holders), _FP, keys_from=staged)
    by_print = F.col("holder").isNotNull() & (F.col("holder_seq").isNull() | (F.col("holder_seq") < F.col("seq")))
    outcomes = settle(
        judged.withColumn(
            "reason",
            F.when(F.col("admitted"), F.lit(None))
            .when(F.col("fault").isNotNull(), F.col("fault"))
            .when(F.col("user_id").isNull(), F.lit("no_owner"))
            .when(by_print, F.lit("duplicate_fingerprint"))
            .otherwise(F.lit("duplicate_name")),
        )
        .withColumn(
            "message",
            F.when(
                F.col("reason") == "duplicate_fingerprint",
                duplicate_task_message("holder.task_group", "holder.task_name"),
            ).when(F.col("reason") == "duplicate_name", duplicate_name_message("task_name")),
        )
        .withColumn("outcome", F.when(F.col("admitted"), F.lit(OK)).otherwise(F.lit(BAD_REQUEST)))
        .select("seq", _FP, *_NAME, "outcome", "reason", "message")
    )

    accepted_seq = outcomes.where(F.col("outcome") == OK).select("seq", _FP)
    rows = lookup_join(filled, accepted_seq, "seq", "inner", unique=True)
    accepted = apply_defaults(rows, {}, ("created_at", "updated_at"), now, id_from=(_FP,))
    accepted = accepted.withColumn("status", F.lit(PENDING).cast("smallint")).withColumn("is_delete", F.lit(False))
    return Admission(
        accepted.select("seq", *TASK_COLUMNS),
        outcomes.where(F.col("outcome") != OK).drop("outcome"),
        outcomes,
    )


# --- runs ----------------------------------------------------------------------------------


def upsert_runs(new_runs: DataFrame, runs: DataFrame, keep_id: bool = False, seq: str = "seq") -> DataFrame:
    """Runs after inserting or overwriting by fingerprint.

    The whole row is replaced, id included unless ``keep_id``; of several new runs of one
    task the latest ``seq`` stays. Existing runs are only filtered, not regrouped.
    """
    latest = last_per_key(new_runs, _FP, seq).select(*RUN_COLUMNS)
    latest = settle(latest)
    kept = lookup_join(runs, latest.select(_FP), _FP, "left_anti", unique=True).select(*RUN_COLUMNS)
    if keep_id:
        old = rows_with_keys(latest.select(_FP), runs, _FP).select(_FP, F.col("id").alias("old_id"))
        latest = (
            lookup_join(latest, old, _FP, unique=True)
            .withColumn("id", F.coalesce("old_id", F.col("id").cast(runs.schema["id"].dataType)))
            .select(*RUN_COLUMNS)
        )
    return kept.unionByName(_typed_like(latest, kept))


def _typed_like(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema])


class LifeCycle(NamedTuple):
    """One outcome per request and the new state of tasks and runs."""

    outcomes: DataFrame
    tasks: DataFrame
    runs: DataFrame


def _with_status(table: DataFrame, keys: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Rewrite some columns of the rows whose key is listed; the table is not shuffled when
    the list is small."""
    marked = lookup_join(table, settle(keys.select(key).distinct()).withColumn("__hit", F.lit(True)), key, unique=True)
    return marked.select(
        *[
            F.when(F.col("__hit"), changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in changes
            else F.col(f.name)
            for f in table.schema
        ]
    )


def begin_tasks(
    requests: DataFrame,
    tasks: DataFrame,
    rules: DataFrame,
    runs: DataFrame,
    users: DataFrame,
    now: Column | None = None,
    keep_id: bool = False,
) -> LifeCycle:
    """Begin tasks: build each task's run from its content and its platform's rule, upsert it,
    set the task's status to begun.

    A request has ``seq``, ``user_id`` and ``task_id``. No rule, empty content, a rule without
    ``basic`` or content without a usable ``priority`` or ``cron_expr`` is refused with 400 and
    leaves the task alone. Neither the deleted flag nor the current status is looked at.
    """
    asked = task_access(requests, tasks, users, carry=(_FP, "source_platform", "task_content"))
    usable = rules.select(
        "source_platform",
        F.lit(True).alias("has_rule"),
        F.array_contains(F.json_object_keys("crawl_rule"), "basic").alias("has_basic"),
        rule_keys("crawl_rule").alias("rule_fields"),
    )
    # one column per parse, so that no content is read twice for the same thing
    ruled = (
        lookup_join(settle(asked), usable, "source_platform")
        .withColumn("__content", F.when(F.col("outcome") == OK, compact_json("task_content")))
        .withColumn("__missing", missing_fields("__content", ("priority", "cron_expr")))
        .withColumn("__priority", F.get_json_object("__content", "$.priority").try_cast("smallint"))
        .withColumn("__cron", F.get_json_object("__content", "$.cron_expr"))
    )
    empty = F.coalesce(F.regexp_replace("task_content", r"\s", ""), F.lit("")).isin("", "{}", "null")
    fault = (
        F.when(F.col("has_rule").isNull() | empty, F.lit(RULE_FAULT))
        .when(~F.coalesce("has_basic", F.lit(False)), F.lit("'basic'"))
        .when(F.array_contains("__missing", "priority"), F.lit("'priority'"))
        .when(F.array_contains("__missing", "cron_expr"), F.lit("'cron_expr'"))
        .when(F.col("rule_fields").isNull(), F.lit("basic is no list of fields"))
        .when(F.col("__priority").isNull(), F.lit("priority is no small integer"))
        .when(F.coalesce(F.length("__cron") > 50, F.lit(True)), F.lit("cron_expr is no short text"))
    )
    decided = settle(
        ruled.withColumn("__fault", F.when(F.col("outcome") == OK, fault))
        .withColumn("outcome", F.when(F.col("__fault").isNotNull(), F.lit(BAD_REQUEST)).otherwise(F.col("outcome")))
        .withColumn("reason", F.coalesce("reason", "__fault"))
        .withColumn("priority", F.when(F.col("outcome") == OK, F.col("__priority")))
        .withColumn("cron_expr", F.when(F.col("outcome") == OK, F.col("__cron")))
        .withColumn("crawl_task", F.when(F.col("outcome") == OK, project_content("__content", "rule_fields")))
        .select(*requests.columns, _FP, "source_platform", "priority", "cron_expr", "crawl_task", "outcome", "reason")
    )
    good = decided.where(F.col("outcome") == OK)
    time = F.current_timestamp() if now is None else now
    new_runs = good.select(
        "seq",
        row_id(_FP, "seq").alias("id"),
        _FP,
        "source_platform",
        "priority",
        "cron_expr",
        "crawl_task",
        F.lit(PENDING).cast("smallint").alias("status"),
        F.lit(None).cast("string").alias("error_reason"),
        F.lit(False).alias("enabled"),
        time.alias("started_at"),
        time.alias("finished_at"),
    )
    begun = good.select(F.col("task_id").alias("id"))
    return LifeCycle(
        decided.select(*requests.columns, "outcome", "reason"),
        _with_status(tasks, begun, "id", {"status": F.lit(BEGIN)}),
        upsert_runs(new_runs, runs, keep_id),
    )


def _end_tasks(requests, tasks, runs, users, task_changes: dict[str, Column]) -> LifeCycle:
    asked = settle(task_access(requests, tasks, users, carry=(_FP,)))
    has_run = keys_present(asked.select(_FP), runs, _FP).withColumn("has_run", F.lit(True))
    no_run = (F.col("outcome") == OK) & F.col("has_run").isNull()
    decided = settle(
        lookup_join(asked, has_run, _FP)
        .withColumn("reason", F.when(no_run, F.lit(NO_RUN)).otherwise(F.col("reason")))
        .withColumn("outcome", F.when(no_run, F.lit(SERVER_ERROR)).otherwise(F.col("outcome")))
        .select(*requests.columns, _FP, "outcome", "reason")
    )
    good = decided.where(F.col("outcome") == OK)
    return LifeCycle(
        decided.select(*requests.columns, "outcome", "reason"),
        _with_status(tasks, good.select(F.col("task_id").alias("id")), "id", task_changes),
        _with_status(runs, good.select(_FP), _FP, {"status": F.lit(KILL)}),
    )


def stop_tasks(requests: DataFrame, tasks: DataFrame, runs: DataFrame, users: DataFrame) -> LifeCycle:
    """Stop tasks: task and run become stopped. A task without a run fails as ``no_run``."""
    return _end_tasks(requests, tasks, runs, users, {"status": F.lit(KILL)})


def remove_tasks(requests: DataFrame, tasks: DataFrame, runs: DataFrame, users: DataFrame) -> LifeCycle:
    """Soft-delete tasks: the deleted flag is set and the run stopped; the task keeps its
    status. A task without a run fails as ``no_run`` and stays undeleted."""
    return _end_tasks(requests, tasks, runs, users, {"is_delete": F.lit(True)})


def update_tasks(requests: DataFrame, tasks: DataFrame, users: DataFrame) -> Patched:
    """Patch tasks for those who may: ``seq``, ``user_id`` (the actor), ``task_id``, the patch fields
    and ``present``, the names a request carries.

    Access is decided as for any task (404, 400, 403); an explicit null is then refused with 500.
    The accepted patches apply in ``seq`` order; none of them changes who may patch.
    """
    asked = task_access(requests, tasks, users).withColumn("__fault", F.when(F.col("outcome") == OK, null_fault(TASK_PATCH_FIELDS)))
    decided = settle(
        asked.withColumn("reason", F.coalesce("reason", "__fault"))
        .withColumn("outcome", F.when(F.col("__fault").isNotNull(), F.lit(SERVER_ERROR)).otherwise(F.col("outcome")))
        .drop("__fault")
    )
    good = decided.where(F.col("outcome") == OK).withColumnRenamed("task_id", "id")
    return Patched(
        apply_patches(tasks, good, TASK_PATCH_FIELDS), decided.select("seq", "user_id", "task_id", "outcome", "reason")
    )
