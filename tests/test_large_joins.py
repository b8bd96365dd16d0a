"""Joins of large sides stay off the driver, whatever size the planner takes them for."""

from gleanspark.operators import users
from gleanspark.plans.durable import written
from gleanspark.plans.skew import keys_present, lookup_join


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sides_over_the_limits_are_not_broadcast(spark, limits):
    limits(broadcast_maxRows=5)
    fact = written(spark.range(60).selectExpr("id % 20 AS k", "id AS seq"))
    dim = written(spark.range(20).selectExpr("id AS k", "id * 2 AS v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        for unique in (False, True):
            joined = lookup_join(fact, dim, "k", how, unique)
            assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert sorted(r.k for r in keys_present(fact, dim, "k").collect()) == list(range(20))


def test_rounds_of_updates_broadcast_nothing(spark):
    rows = "id % 7 AS seq, cast(id AS string) AS id, cast(id % 3 AS string) AS actor_id, 'a' AS email, 'a' AS claim"
    rows = f"{rows}, true AS moves, cast(null AS string) AS fault, true AS new_active, cast(null AS boolean) AS new_superuser"
    state = "cast(id AS string) AS id, concat('m', id) AS email, true AS is_active, true AS is_superuser"
    seen = users._with_state(written(spark.range(9).selectExpr(*rows.split(", "))), written(spark.range(9).selectExpr(*_split(state))), True)
    assert "Broadcast" not in plan(seen) and seen.count() == 9


def _split(text):
    return text.replace("concat('m', id)", "'m' || id").split(", ")
