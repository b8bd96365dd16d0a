"""Queries over data in which one key, owner or content holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from tests.conftest import SMALL

UNCHANGED = "region nation supplier documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def hot_folder(spark, tmp_path_factory):
    """The smallest data set with a third of its orders, events, order lines and parts alike."""
    folder = str(tmp_path_factory.mktemp("hot"))

    def third(name, **same):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        hot = F.xxhash64(*df.columns) % 3 == 0
        for column, value in same.items():
            held = df.schema[column].dataType
            df = df.withColumn(column, F.when(hot, F.lit(value).cast(held)).otherwise(F.col(column)))
        df.write.parquet(f"{folder}/{name}.parquet")

    third("orders", o_custkey=7, o_orderpriority="1-URGENT", o_orderdate="1997-07-07")
    third("events", user_id=7, event_type="click", props='{"k": 7}')
    third("lineitem", l_orderkey=7)
    third("part", p_size=7)
    third("customer", c_mktsegment="BUILDING")
    for name in UNCHANGED:
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(hot_folder):
    return connect(hot_folder, "/*.parquet")


HOT = [
    "tasks_of_owners",
    "visible_tasks",
    "visible_tasks_shared",
    "page_desc",
    "page_desc_deep",
    "task_access",
    "user_access",
    "superuser_only",
    "exactly_one",
    "first_per_key",
    "exists_in",
    "tasks_with_rule",
    "admit_tasks",
    "upsert_runs",
    "patch_rows_state",
    "begin_tasks_runs",
    "admit_users",
    "delete_users",
    "update_users_state",
    "unique_violations",
]


@pytest.mark.parametrize("name", HOT)
def test_hot_keys(spark, duck, hot_folder, limits, name):
    limits(broadcast_maxRows=20, hotKey_rows=50)
    assert compare(spark, duck, hot_folder, name) is None
