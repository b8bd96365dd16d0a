"""Rows every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

LONG = "a" * 150_000 + " " + "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (6, LONG),
    (7, LONG),
    (8, "Ünïcode — 日本語 \U0001f600 the end"),
    (None, "a row without an id"),
    (None, None),
]
# texts that patterns with unbounded repeats choke on
HARD = ["x@" + "a." * 20_000 + " 1", "a1" + "b" * 100_000, "7" * 100_000, "a." * 50_000 + "@1", "A1-" * 40_000, "Mr a " * 40_000]
CLASHING = (
    "fingerprint component_id root shard i j score held_out predicted k1 k2 body w n at items token words start size "
    "ids decoded mention kind entity found name digest path key print keys h d own other"
).split()


def odd_docs(spark):
    """The rows above with columns whose names the operators use themselves."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    return docs.withColumns({name: F.lit("x") for name in CLASHING})


def no_docs(spark):
    return odd_docs(spark).where("false")
