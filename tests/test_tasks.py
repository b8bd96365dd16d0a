"""Task operators against one-by-one models, on random batches and hand-made cases."""

import json
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import access, filters, tasks
from gleanspark.sources.schemas import RUN_COLUMNS

REQUEST = "seq long, user_id long, source_platform string, task_content string, task_name string, task_group string"
TASK = (
    "id string, task_group string, task_name string, task_content string, source_platform string, "
    "task_fingerprint string, status smallint, is_delete boolean, user_id long"
)
NOW = "timestamp_ntz '2024-05-01 00:00:00'"


def task_frame(spark, rows):
    df = spark.createDataFrame(rows, TASK)
    return df.withColumn("created_at", F.expr(NOW)).withColumn("updated_at", F.expr(NOW))


def run_frame(spark, rows):
    """Rows of (id, fingerprint, status)."""
    df = spark.createDataFrame(rows, "id string, task_fingerprint string, status smallint")
    return df.select(
        "id", "task_fingerprint", F.lit("p").alias("source_platform"), F.lit(5).cast("smallint").alias("priority"),
        F.lit("* * *").alias("cron_expr"), F.lit("{}").alias("crawl_task"), "status",
        F.lit("old error").alias("error_reason"), F.lit(True).alias("enabled"),
        F.expr(NOW).alias("started_at"), F.expr(NOW).alias("finished_at"),
    )


def users_frame(spark):
    return spark.createDataFrame([(1, True), (2, False), (3, False)], "id long, is_superuser boolean")


def admission_model(existing, requests):
    """Existing (fp, user, name) triples; requests in seq order."""
    prints = {e[0] for e in existing}
    names = {(e[1], e[2]) for e in existing}
    outcome = {}
    for seq, fp, user, name in sorted(requests):
        if fp in prints:
            outcome[seq] = "duplicate_fingerprint"
        elif (user, name) in names:
            outcome[seq] = "duplicate_name"
        else:
            prints.add(fp)
            names.add((user, name))
            outcome[seq] = None
    return outcome


def run_admission(spark, existing, requests):
    """Contents stand for fingerprints: the same number is the same fingerprint."""
    seen = task_frame(
        spark,
        [(f"e{i}", "g", n, f'{{"k": {fp}}}', "p", None, 0, i % 2 == 0, u) for i, (fp, u, n) in enumerate(existing)],
    ).withColumn("task_fingerprint", F.md5(F.concat("source_platform", F.translate("task_content", '"', "'"))))
    df = spark.createDataFrame([(s, u, "p", f'{{"k": {fp}}}', n, "g") for s, fp, u, n in requests], REQUEST)
    return tasks.admit_tasks(df, seen)


def random_batch(rng, size):
    existing, used = [], set()
    for _ in range(rng.randrange(6)):
        fp, user, name = rng.randrange(12), rng.randrange(3), f"n{rng.randrange(4)}"
        if fp not in {e[0] for e in existing} and (user, name) not in used:
            existing.append((fp, user, name))
            used.add((user, name))
    hot = rng.random() < 0.5  # one fingerprint takes a third of the batch
    requests = [
        (i, 0 if hot and rng.random() < 0.34 else rng.randrange(12), rng.randrange(3), f"n{rng.randrange(8)}")
        for i in rng.sample(range(size * 3), size)
    ]
    return existing, requests


@pytest.mark.parametrize("seed", range(3))
def test_admission_equals_one_by_one(spark, seed):
    existing, requests = random_batch(random.Random(seed), 80)
    got = run_admission(spark, existing, requests)
    assert {r["seq"]: r["reason"] for r in got.outcomes.collect()} == admission_model(existing, requests)


@pytest.mark.parametrize("rows", [0, 6])
def test_admission_in_rounds_and_by_components(spark, limits, rows):
    limits(ordered_maxRows=rows)
    existing, requests = random_batch(random.Random(17), 60)
    got = run_admission(spark, existing, requests)
    assert {r["seq"]: r["reason"] for r in got.outcomes.collect()} == admission_model(existing, requests)


def test_long_chains_are_parted(spark, limits):
    """Forty chains of thirty requests: more than one pass holds, none of them too long for one."""
    limits(ordered_maxRows=100)
    chain = [(i * 40 + c, (i + 1) // 2 + 100 * c, c, f"n{i // 2}") for i in range(30) for c in range(40)]
    rows = spark.createDataFrame([(s, f"f{f}", u, n) for s, f, u, n in chain], "seq long, task_fingerprint string, user_id long, task_name string")
    admitted = {r["seq"] for r in tasks._greedy(rows).collect()}
    assert admitted == {s for s, why in admission_model([], chain).items() if why is None}


def test_a_chain_of_5000_takes_few_jobs(spark):
    chain = [(i, (i + 1) // 2, 1, f"n{i // 2}") for i in range(5000)]
    rows = spark.createDataFrame([(s, f"f{f}", u, n) for s, f, u, n in chain], "seq long, task_fingerprint string, user_id long, task_name string")
    spark.sparkContext.setJobGroup("chain", "chain")
    admitted = {r["seq"] for r in tasks._greedy(rows).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setJobGroup("", "")
    assert admitted == set(range(0, 5000, 2)) and len(jobs) < 12


def test_update_tasks(spark):
    task, _, _, users = life_tables(spark)
    rows = [
        (1, 2, "t1", "G1", None, None, ["task_group"]),
        (2, 3, "t1", "no", None, None, ["task_group"]),
        (3, 1, "t1", None, "N3", True, ["task_name", "is_delete"]),
        (4, 2, "t1", None, None, None, ["task_name"]),
        (5, 9, "t1", "no", None, None, ["task_group"]),
        (6, 1, "gone", "no", None, None, ["task_group"]),
        (7, 2, "t1", "G7", None, None, ["task_group"]),
    ]
    asked = spark.createDataFrame(
        rows, "seq long, user_id long, task_id string, task_group string, task_name string, is_delete boolean, present array<string>"
    )
    got = tasks.update_tasks(asked, task, users)
    assert {r["seq"]: (r["outcome"], r["reason"]) for r in got.outcomes.collect()} == {
        1: (200, None), 2: (403, access.NO_PERMISSION), 3: (200, None), 4: (500, "null in task_name"),
        5: (404, access.ACTOR_NOT_FOUND), 6: (404, access.TASK_NOT_FOUND), 7: (200, None),
    }
    state = {r["id"]: (r["task_group"], r["task_name"], r["is_delete"], r["status"]) for r in got.state.collect()}
    before = {r["id"]: (r["task_group"], r["task_name"], r["is_delete"], r["status"]) for r in task.collect()}
    assert state == {**before, "t1": ("G7", "N3", True, 0)}


def test_admission_with_split_keys(spark, split_everything):
    existing, requests = random_batch(random.Random(11), 60)
    got = run_admission(spark, existing, requests)
    assert {r["seq"]: r["reason"] for r in got.outcomes.collect()} == admission_model(existing, requests)


def test_admission_chain(spark):
    """Each request depends on the one before: only every second one gets in."""
    chain = [(i, (i + 1) // 2, 1, f"n{i // 2}") for i in range(24)]
    got = run_admission(spark, [], chain)
    want = admission_model([], chain)
    assert {r["seq"]: r["reason"] for r in got.outcomes.collect()} == want
    assert got.accepted.count() == sum(v is None for v in want.values())


def test_admission_refuses_faulty_fields(spark):
    rows = [
        (1, 1, "p", '{"k": 1}', "n" * 201, "g", None),
        (2, 1, "p", "{broken", "b", "g", None),
        (3, 1, "p", '{"k": 3}', None, "g", ["task_name"]),
        (4, 1, "p", '{"k": 4}', None, "g", ["task_group"]),
        (5, 1, "p" * 51, '{"k": 5}', "e", "g", None),
        (6, 1, "p", '{"键": "值 é"}', "f", "g", None),
    ]
    df = spark.createDataFrame(rows, REQUEST + ", present array<string>")
    got = tasks.admit_tasks(df, task_frame(spark, []))
    assert {r["seq"]: r["reason"] for r in got.outcomes.collect()} == {
        1: "task_name is too long", 2: "task_content is no JSON", 3: "task_name is null", 4: None,
        5: "source_platform is too long", 6: None,
    }
    printed = {r["seq"]: r["task_fingerprint"] for r in got.outcomes.collect()}
    assert printed[6] == hashlib.md5("p{'键': '值 é'}".encode()).hexdigest()


def test_refused_request_leaves_its_keys_free(spark):
    got = run_admission(spark, [(99, 1, "old")], [(1, 10, 1, "X"), (2, 11, 1, "X"), (3, 11, 1, "Y"), (4, 99, 2, "Z")])
    by_seq = {r["seq"]: r for r in got.outcomes.collect()}
    assert [by_seq[s]["outcome"] for s in (1, 2, 3, 4)] == [200, 400, 200, 400]
    assert by_seq[2]["message"] == "该任务名称 [X] 重复，请更换名称。"
    assert by_seq[4]["message"] == "该任务已在系统中存在：[g - old]"
    accepted = got.accepted.collect()
    assert {r["seq"] for r in accepted} == {1, 3}
    assert {(r["status"], r["is_delete"]) for r in accepted} == {(0, False)}
    assert {r["seq"] for r in got.rejected.collect()} == {2, 4}


def test_admission_fills_defaults_and_needs_an_owner(spark):
    df = spark.createDataFrame([(1, 7, '{"a": 1}'), (2, None, '{"a": 2}'), (3, 7, '{"a": 3}')],
                               "seq long, user_id long, task_content string")
    got = tasks.admit_tasks(df, task_frame(spark, []))
    assert {r["seq"]: r["reason"] for r in got.outcomes.collect()} == {1: None, 2: "no_owner", 3: "duplicate_name"}
    row = got.accepted.first()
    assert (row["task_group"], row["task_name"], row["source_platform"]) == ("default group", "default name", "")


def upsert_model(new, old, keep_id):
    state = {fp: (i, s) for i, fp, s in old}
    for seq, i, fp, s in sorted(new):
        state[fp] = (state[fp][0] if keep_id and fp in state else i, s)
    return state


@pytest.mark.parametrize("keep_id", [False, True])
def test_upsert_equals_one_by_one(spark, keep_id):
    rng = random.Random(5)
    old = [(f"o{i}", f"f{i}", 3) for i in range(0, 20, 2)]
    new = [(s, f"n{s}", f"f{rng.randrange(20)}", rng.randrange(3)) for s in range(40)]
    fresh = run_frame(spark, [(i, fp, s) for _, i, fp, s in new]).withColumn("seq", F.substring("id", 2, 9).cast("long"))
    state = tasks.upsert_runs(fresh, run_frame(spark, old), keep_id)
    assert state.columns == RUN_COLUMNS
    got = {r["task_fingerprint"]: (r["id"], r["status"]) for r in state.collect()}
    assert len(got) == state.count()
    if keep_id:  # the last new row decides all but the id; a new key takes its last row's id
        want = upsert_model(new, old, True)
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert all(got[fp][0] == i for i, fp, _ in old)
    else:
        assert got == upsert_model(new, old, False)


def life_tables(spark):
    content = {
        "t1": '{"priority": 5, "cron_expr": "* *", "a": 1, "b": {"x": 2}}',
        "t2": '{"cron_expr": "* *"}',
        "t3": '{"priority": 5}',
        "t4": "{}",
        "t5": '{"priority": null, "cron_expr": "* *"}',
        "t6": '{"priority": 5, "cron_expr": "* *"}',
        "t7": '{"priority": 5, "cron_expr": "* *"}',
        "t8": '{"priority": 7, "cron_expr": "1 *", "a": 3}',
    }
    platform = {"t6": "none", "t7": "nobasic", "t8": "object"}
    rows = [
        (t, "g", t, c, platform.get(t, "list"), f"f-{t}", 3 if t == "t8" else 0, t == "t8", 2 if t != "t3" else 3)
        for t, c in content.items()
    ]
    rules = spark.createDataFrame(
        [
            ("list", '{"basic": ["a", "priority"]}'),
            ("object", '{"basic": {"a": "int"}}'),
            ("nobasic", '{"more": []}'),
        ],
        "source_platform string, crawl_rule string",
    )
    return task_frame(spark, rows), rules, run_frame(spark, [("r8", "f-t8", 3), ("r2", "f-t2", 1)]), users_frame(spark)


def requests_frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, user_id long, task_id string")


def test_begin(spark):
    task, rules, runs, users = life_tables(spark)
    asked = [(i, 2, f"t{i}") for i in range(1, 9)] + [(9, 2, "gone"), (10, 1, "t3"), (11, 9, "t1"), (12, 2, "t1")]
    got = tasks.begin_tasks(requests_frame(spark, asked), task, rules, runs, users, F.expr(NOW))
    outcomes = {r["seq"]: (r["outcome"], r["reason"]) for r in got.outcomes.collect()}
    assert outcomes == {
        1: (200, None),
        2: (400, "'priority'"),
        3: (403, access.NO_PERMISSION),
        4: (400, tasks.RULE_FAULT),
        5: (400, "priority is no small integer"),
        6: (400, tasks.RULE_FAULT),
        7: (400, "'basic'"),
        8: (200, None),
        9: (404, access.TASK_NOT_FOUND),
        10: (400, "'cron_expr'"),
        11: (404, access.ACTOR_NOT_FOUND),
        12: (200, None),
    }
    status = {r["id"]: r["status"] for r in got.tasks.collect()}
    assert {t for t, s in status.items() if s == 1} == {"t1", "t8"}
    run = {r["task_fingerprint"]: r for r in got.runs.collect()}
    assert set(run) == {"f-t1", "f-t2", "f-t8"}
    assert (run["f-t2"]["id"], run["f-t2"]["status"]) == ("r2", 1)  # untouched
    again = run["f-t8"]  # begun again, although deleted and completed
    assert (again["status"], again["error_reason"], again["enabled"], again["priority"]) == (0, None, False, 7)
    assert again["id"] != "r8"
    assert json.loads(again["crawl_task"]) == {"a": 3}
    assert json.loads(run["f-t1"]["crawl_task"]) == {"priority": 5, "a": 1}
    kept = tasks.begin_tasks(requests_frame(spark, [(1, 2, "t8")]), task, rules, runs, users, F.expr(NOW), keep_id=True)
    assert {r["id"] for r in kept.runs.where("task_fingerprint = 'f-t8'").collect()} == {"r8"}


def test_stop_and_remove(spark):
    task, _, runs, users = life_tables(spark)
    asked = requests_frame(spark, [(1, 2, "t8"), (2, 2, "t1"), (3, 3, "t2"), (4, 1, "t2"), (5, 2, "gone")])
    stopped = tasks.stop_tasks(asked, task, runs, users)
    want = {1: 200, 2: 500, 3: 403, 4: 200, 5: 404}
    assert {r["seq"]: r["outcome"] for r in stopped.outcomes.collect()} == want
    assert {r["id"]: r["status"] for r in stopped.tasks.collect() if r["id"] in ("t1", "t2", "t8")} == {
        "t1": 0, "t2": -2, "t8": -2,
    }
    assert {r["status"] for r in stopped.runs.collect()} == {-2}

    removed = tasks.remove_tasks(asked, task, runs, users)
    assert {r["seq"]: r["reason"] for r in removed.outcomes.collect()}[2] == tasks.NO_RUN
    state = {r["id"]: (r["status"], r["is_delete"]) for r in removed.tasks.collect()}
    assert (state["t2"], state["t8"], state["t1"]) == ((0, True), (3, True), (0, False))


def test_joins_report_missing_sides(spark):
    task, rules, runs, _ = life_tables(spark)
    status = {r["id"]: r["rule_status"] for r in tasks.tasks_with_rule(task, rules).collect()}
    assert (status["t1"], status["t4"], status["t6"]) == ("ok", "empty_content", "no_rule")
    joined = {r["id"]: r["run_status"] for r in tasks.tasks_with_run(task, runs).collect()}
    assert (joined["t1"], joined["t8"]) == (None, 3)


def test_access_decisions(spark):
    task, _, _, users = life_tables(spark)
    asked = requests_frame(spark, [(1, 1, "gone"), (2, 2, "gone"), (3, 2, "t1"), (4, 3, "t1"), (5, 1, "t1")])
    got = {r["seq"]: r["outcome"] for r in access.task_access(asked, task, users).collect()}
    assert got == {1: 404, 2: 404, 3: 200, 4: 403, 5: 200}
    views = spark.createDataFrame(
        [(1, 1, 99), (2, 2, 99), (3, 2, 2), (4, 2, 3), (5, 1, 3)], "seq long, user_id long, target_id long"
    )
    got = {r["seq"]: r["outcome"] for r in access.user_access(views, users).collect()}
    assert got == {1: 404, 2: 403, 3: 200, 4: 403, 5: 200}


def test_actors_must_be_known_and_active(spark):
    task, _, _, _ = life_tables(spark)
    users = spark.createDataFrame(
        [(1, True, False), (2, False, True), (3, True, None)], "id long, is_superuser boolean, is_active boolean"
    )
    asked = requests_frame(spark, [(1, 1, "t1"), (2, 2, "t1"), (3, 3, "t1"), (4, 9, "t1")])
    got = {r["seq"]: (r["outcome"], r["reason"]) for r in access.task_access(asked, task, users).collect()}
    assert got == {1: (400, "Inactive user"), 2: (200, None), 3: (400, "Inactive user"), 4: (404, "User not found")}
    views = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (4, 9, 9)], "seq long, user_id long, target_id long")
    got = {r["seq"]: r["outcome"] for r in access.user_access(views, users).collect()}
    assert got == {1: 400, 2: 200, 4: 404}
    assert filters.superuser_only(asked, users).count() == 0
