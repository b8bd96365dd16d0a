import pytest

from gleanspark.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", name="gleanspark-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Set package limits for one test."""
    touched = []

    def set_limits(**values):
        for name, value in values.items():
            key = "gleanspark." + name.replace("_", ".", 1)
            spark.conf.set(key, str(value))
            touched.append(key)

    yield set_limits
    for key in touched:
        spark.conf.unset(key)


@pytest.fixture
def split_everything(limits):
    """Limits under which nothing is broadcast and every repeated key is hot."""
    limits(broadcast_maxRows=0, hotKey_rows=2)
