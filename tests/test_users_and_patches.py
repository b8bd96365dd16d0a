"""User mutations and partial patches against one-by-one models."""

import random

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import integrity, patching, users

USER = "id long, email string, is_active boolean, is_superuser boolean, full_name string, hashed_password string"
PATCH = "seq long, id long, email string, is_active boolean, is_superuser boolean, full_name string, hashed_password string, present array<string>"
NOW = "timestamp_ntz '2024-05-01 00:00:00'"


def user_frame(spark, n=8):
    rows = [(i, f"u{i}@x.org", True, i == 0, None if i % 2 else f"User {i}", "h") for i in range(n)]
    return spark.createDataFrame(rows, USER).withColumn("created_at", F.expr(NOW))


def test_patches_equal_one_by_one(spark):
    rng = random.Random(2)
    base = spark.createDataFrame([(i, f"g{i}", f"n{i}", i % 2 == 0, i) for i in range(10)],
                                 "id long, task_group string, task_name string, is_delete boolean, other int")
    patches, state = [], {i: [f"g{i}", f"n{i}", i % 2 == 0] for i in range(10)}
    want = {}
    for seq in range(60):
        key = rng.randrange(12)
        present = [f for f in patching.TASK_PATCH_FIELDS if rng.random() < 0.5]
        values = {
            "task_group": None if rng.random() < 0.1 else f"G{seq}",
            "task_name": None if rng.random() < 0.1 else f"N{seq}",
            "is_delete": rng.random() < 0.5,
        }
        patches.append((seq, key, *[values[f] if f in present else None for f in patching.TASK_PATCH_FIELDS], present))
        nulls = [f for f in present if values[f] is None]
        want[seq] = 404 if key not in state else 500 if nulls else 200
        if want[seq] == 200:
            for i, f in enumerate(patching.TASK_PATCH_FIELDS):
                if f in present:
                    state[key][i] = values[f]
    df = spark.createDataFrame(
        patches, "seq long, id long, task_group string, task_name string, is_delete boolean, present array<string>"
    )
    got = patching.patch_rows(base, df)
    assert {r["seq"]: r["outcome"] for r in got.outcomes.collect()} == want
    assert {r["id"]: [r["task_group"], r["task_name"], r["is_delete"]] for r in got.state.collect()} == state
    assert got.state.columns == base.columns


def test_explicit_null_is_written_where_allowed(spark):
    base = user_frame(spark).select("id", "full_name", "email")
    patches = spark.createDataFrame(
        [(1, 0, None, None, ["full_name"]), (2, 2, None, None, [])],
        "seq long, id long, full_name string, email string, present array<string>",
    )
    got = patching.patch_rows(base, patches, ("full_name", "email"), not_null=("email",))
    assert {r["id"]: r["full_name"] for r in got.state.collect() if r["id"] in (0, 2)} == {0: None, 2: "User 2"}
    assert {r["outcome"] for r in got.outcomes.collect()} == {200}


def test_admit_users(spark):
    asked = spark.createDataFrame(
        [(3, "a@x.org", "p"), (1, "a@x.org", "q"), (2, "u1@x.org", "r"), (4, "b@x.org", "s")],
        "seq long, email string, hashed_password string",
    )
    got = users.admit_users(asked, user_frame(spark), F.expr(NOW))
    assert {r["seq"]: r["outcome"] for r in got.outcomes.collect()} == {1: 200, 2: 400, 3: 400, 4: 200}
    rows = {r["email"]: r for r in got.accepted.collect()}
    assert rows["a@x.org"]["hashed_password"] == "q"
    assert (rows["b@x.org"]["is_active"], rows["b@x.org"]["is_superuser"], rows["b@x.org"]["full_name"]) == (True, False, None)
    # the same batch gives the same ids again
    again = users.admit_users(asked, user_frame(spark), F.expr(NOW)).accepted.collect()
    assert {r["id"] for r in again} == {r["id"] for r in rows.values()}


def test_delete_users(spark):
    asked = spark.createDataFrame(
        [(1, 0, 3), (2, 0, 3), (3, 0, 0), (4, 0, 99), (5, 2, 4), (6, 0, 5), (7, 42, 6)],
        "seq long, actor_id long, user_id long",
    )
    owned = spark.createDataFrame([(5,), (5,)], "user_id long")
    got = users.delete_users(asked, user_frame(spark), owned)
    assert {r["seq"]: r["outcome"] for r in got.outcomes.collect()} == {
        1: 200, 2: 404, 3: 403, 4: 404, 5: 403, 6: 500, 7: 404,
    }
    assert {r["id"] for r in got.state.collect()} == set(range(8)) - {3}


def delete_model(states, requests):
    """One by one: states is id -> (is_superuser, is_active)."""
    left, out = dict(states), {}
    for seq, actor, user in sorted(requests):
        if actor not in left:
            out[seq] = (404, "User not found")
        elif not left[actor][1]:
            out[seq] = (400, "Inactive user")
        elif not left[actor][0]:
            out[seq] = (403, users.NO_PERMISSION_GATE)
        elif user not in left:
            out[seq] = (404, users.USER_NOT_FOUND)
        elif user == actor:
            out[seq] = (403, users.NO_SELF_DELETE)
        else:
            out[seq] = (200, None)
            del left[user]
    return out, set(left)


@pytest.mark.parametrize("seed", range(4))
def test_deletions_are_decided_in_order(spark, seed):
    rng = random.Random(seed)
    states = {i: (rng.random() < 0.7, rng.random() < 0.9) for i in range(14)}
    requests = [(i, rng.randrange(16), rng.randrange(16)) for i in range(60)]
    if seed == 0:  # two superusers delete each other
        states, requests = {1: (True, True), 2: (True, True)}, [(1, 1, 2), (2, 2, 1)]
    frame = spark.createDataFrame([(i, *s) for i, s in states.items()], "id long, is_superuser boolean, is_active boolean")
    asked = spark.createDataFrame(requests, "seq long, actor_id long, user_id long")
    got = users.delete_users(asked, frame, spark.createDataFrame([], "user_id long"))
    want, left = delete_model(states, requests)
    assert {r["seq"]: (r["outcome"], r["reason"]) for r in got.outcomes.collect()} == want
    assert {r["id"] for r in got.state.collect()} == left


def test_seed_if_absent(spark):
    base = user_frame(spark)
    seed = spark.createDataFrame([(100, "root@x.org"), (101, "u1@x.org")], "id long, email string")
    seed = seed.select("id", "email", F.lit(True).alias("is_active"), F.lit(True).alias("is_superuser"),
                       F.lit("超级管理员").alias("full_name"), F.lit("h").alias("hashed_password"),
                       F.expr(NOW).alias("created_at"))
    once = users.seed_if_absent(base, seed, "email")
    assert {r["id"] for r in once.collect()} == set(range(8)) | {100}
    assert users.seed_if_absent(once, seed, "email").count() == 9


def update_model(people, patches, form, gated):
    """One by one: people is id -> [email, is_active, is_superuser, full_name]."""
    state, out = {i: list(p) for i, p in people.items()}, {}
    fields = {"email": 0, "is_active": 1, "is_superuser": 2, "full_name": 3} if form == "admin" else {"email": 0, "full_name": 3}
    for seq, key, actor, values, present in sorted(patches, key=lambda p: p[0]):
        actor = key if form == "self" else actor
        sent = {f: values[f] for f in present if f in fields}
        if (gated or form == "self") and actor not in state:
            out[seq] = (404, "User not found")
        elif (gated or form == "self") and not state[actor][1]:
            out[seq] = (400, "Inactive user")
        elif gated and form == "admin" and not state[actor][2]:
            out[seq] = (403, users.NO_PERMISSION_GATE)
        elif key not in state:
            out[seq] = (404, users.ID_NOT_FOUND)
        elif sent.get("email") and any(p[0] == sent["email"] and i != key for i, p in state.items()):
            out[seq] = (409, users.EMAIL_EXISTS_ON_UPDATE)
        elif nulls := [f for f in ("email", "is_active", "is_superuser") if f in sent and sent[f] is None]:
            out[seq] = (500, f"null in {nulls[0]}")
        else:
            out[seq] = (200, None)
            for f, v in sent.items():
                state[key][fields[f]] = v
    return out, state


def random_patches(rng, n):
    """Few addresses among few users, so that they are taken, given up and taken again."""
    patches = []
    for seq in rng.sample(range(n * 3), n):
        values = {
            "email": rng.choice([f"u{rng.randrange(8)}@x.org", f"u{rng.randrange(8)}@x.org", f"new{rng.randrange(4)}@x.org", None, ""]),
            "full_name": rng.choice([f"name {seq}", None]),
            "is_active": rng.choice([True, True, False, None]),
            "is_superuser": rng.choice([True, True, False]),
        }
        if values["email"] == "":
            values["email"] = f"only{seq}@x.org"
        present = [f for f, share in zip(values, (0.8, 0.4, 0.2, 0.2), strict=True) if rng.random() < share]
        patches.append((seq, rng.randrange(10), rng.choice([0, 0, 1, 2, 9]), {f: values[f] if f in present else None for f in values}, present))
    return patches


@pytest.mark.parametrize(
    ("form", "gated", "rows"),
    [("admin", False, 200_000), ("admin", True, 200_000), ("self", False, 200_000), ("admin", True, 0), ("admin", False, 12), ("self", False, 0)],
)
def test_update_users_equals_one_by_one(spark, limits, form, gated, rows):
    limits(ordered_maxRows=rows)
    rng = random.Random(f"{form}{gated}")
    patches = random_patches(rng, 60)
    people = {i: [f"u{i}@x.org", i != 7, i < 3, None if i % 2 else f"User {i}"] for i in range(8)}
    schema = "seq long, id long, actor_id long, email string, is_active boolean, is_superuser boolean, full_name string, present array<string>"
    df = spark.createDataFrame(
        [(s, k, a, v["email"], v["is_active"], v["is_superuser"], v["full_name"], p) for s, k, a, v, p in patches], schema
    ).withColumn("hashed_password", F.lit(None).cast("string"))
    base = spark.createDataFrame([(i, *p, "h") for i, p in people.items()], "id long, email string, is_active boolean, is_superuser boolean, full_name string, hashed_password string")
    got = users.update_users(df if gated else df.drop("actor_id"), base, form)
    want, state = update_model(people, patches, form, gated)
    assert {r["seq"]: (r["outcome"], r["reason"]) for r in got.outcomes.collect()} == want
    kept = {r["id"]: [r["email"], r["is_active"], r["is_superuser"], r["full_name"]] for r in got.state.collect()}
    assert kept == state and {v[0] for v in want.values()} >= {200, 409}
    with pytest.raises(ValueError):
        users.update_users(df, base, "other")


def test_emails_swap_and_pass_on(spark):
    patches = [(1, 1, "t@x.org"), (2, 2, "u1@x.org"), (3, 1, "u2@x.org"), (4, 3, "u2@x.org"), (5, 3, "t@x.org"), (6, 4, "u3@x.org")]
    df = spark.createDataFrame([(s, i, e, None, None, None, None, ["email"]) for s, i, e in patches], PATCH)
    got = users.update_users(df, user_frame(spark))
    assert {r["seq"]: r["outcome"] for r in got.outcomes.collect()} == {1: 200, 2: 200, 3: 200, 4: 409, 5: 200, 6: 200}
    emails = {r["id"]: r["email"] for r in got.state.collect()}
    assert [emails[i] for i in (1, 2, 3, 4)] == ["u2@x.org", "u1@x.org", "t@x.org", "u3@x.org"]


def test_admit_users_asks_for_a_superuser(spark):
    asked = spark.createDataFrame(
        [(1, 5, "a@x.org", "p"), (2, 0, "a@x.org", "q"), (3, 99, "b@x.org", "r"), (4, 0, "u1@x.org", "s"), (5, 0, "a@x.org", "t")],
        "seq long, actor_id long, email string, hashed_password string",
    )
    got = users.admit_users(asked, user_frame(spark), F.expr(NOW))
    assert {r["seq"]: (r["outcome"], r["reason"]) for r in got.outcomes.collect()} == {
        1: (403, users.NO_PERMISSION_GATE), 2: (200, None), 3: (404, "User not found"),
        4: (400, users.EMAIL_EXISTS_ON_CREATE), 5: (400, users.EMAIL_EXISTS_ON_CREATE),
    }
    assert [(r["email"], r["hashed_password"]) for r in got.accepted.collect()] == [("a@x.org", "q")]


def test_long_emails_are_no_trouble(spark):
    texts = ["x@a" + ".a" * 20_000, "x@" + "a" * 50_000, "a@b.c", "a@b..c", "@b.c", "a@b.c.", "a@.b.c", "a@b@c.d", "a b@c.d", "a@bc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, email string").withColumn("full_name", F.lit("n"))
    got = integrity.field_violations(rows, integrity.USER_RULES).where("rule = 'not_email'").collect()
    assert {r["id"] for r in got} == {1, 3, 4, 5, 6, 7, 8, 9}


def test_email_conflicts_skip_empty(spark):
    patches = spark.createDataFrame(
        [(1, 1, "u2@x.org"), (2, 2, "u2@x.org"), (3, 3, ""), (4, 4, None)], "seq long, id long, email string"
    )
    assert [r["seq"] for r in integrity.email_conflicts(patches, user_frame(spark)).collect()] == [1]


def test_reports(spark):
    rows = spark.createDataFrame(
        [(1, "a@x.org", "ok"), (2, "a@x.org", "y" * 256), (3, None, None), (4, "no-at", "z"), (5, None, "z")],
        "id long, email string, full_name string",
    )
    dup = integrity.unique_violations(rows, "email").collect()
    assert [(r["email"], r["occurrences"]) for r in dup] == [("a@x.org", 2)]
    got = {(r["id"], r["field"], r["rule"]) for r in integrity.field_violations(rows, integrity.USER_RULES).collect()}
    assert got == {(2, "full_name", "too_long"), (3, "email", "null"), (4, "email", "not_email"), (5, "email", "null")}


def test_apply_defaults(spark):
    sent = spark.createDataFrame([(1, None)], "seq long, task_name string")
    row = integrity.apply_defaults(
        sent, integrity.TASK_DEFAULTS, ("created_at",), F.expr(NOW), id_from=("seq",)
    ).first()
    assert row["task_name"] is None  # sent as null, not left out
    assert (row["task_group"], row["task_content"], row["status"], row["is_delete"]) == ("default group", "{}", 0, False)
    assert len(row["id"]) == 36
