"""Every registered query against its SQL in DuckDB."""

import pytest

from checks.compare import compare, connect
from checks.queries import ORACLE, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name) is None


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


# further ones run over hot data in test_hot.py
JOINING = [
    "record_detail",
    "tasks_of_groups",
    "lookup",
    "tasks_with_run",
    "orphan_tasks",
    "email_conflicts",
    "stop_tasks",
    "remove_tasks",
    "seed_if_absent",
    "publish_outcome",
]


@pytest.mark.parametrize("name", JOINING)
def test_same_without_broadcast_and_with_split_keys(spark, duck, split_everything, name):
    assert compare(spark, duck, SMALL, name) is None
