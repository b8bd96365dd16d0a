"""Benchmark decontamination: a prefix-filtered set join of word shingles, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.shared import stored

WINDOW = 10  # words an occurrence must share with an item
SHINGLE = 5  # words of a token of the set join
BROADCAST_WINDOWS = 400_000  # item windows (about 100 bytes each) up to which they are broadcast

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """Text with A-Z lower-cased; the whole-string function serves where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with two hashes that stand for the row; equal rows share them."""
    return docs.select(
        "doc_id",
        "text",
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2"),
    )


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """``item_id, words, size``: every window of every item; a shorter item is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where("size(all) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1))))
    return (
        items.withColumn("start", starts)
        .select("item_id", F.expr(f"slice(all, start, {window})").alias("list"))
        .select("item_id", F.array_join("list", " ").alias("words"), F.size("list").alias("size"))
        .withColumn("step", F.least(F.lit(shingle), F.col("size")))
        .distinct()
    )


def _key(parts: list[Column], size: int) -> Column:
    return F.xxhash64(F.lit(size), *parts)


def _bounded(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``k1, k2, start, size, words``: where windows of items occur in documents, each once.

    The tokens of a window are its word shingles (of the whole window, if it is shorter). All of
    them must occur, so one token is prefix enough: the rarest in all documents. One pass over
    the documents finds where any token of any window occurs, with the words around it; counts
    over those give the rarity. Only prefix tokens are joined to windows. The position of the
    token in the window then bounds where the window would start and end in the document, and
    the words there are compared.
    """
    windows = stored(item_windows(benchmark, window, shingle).select("words", "size", "step").distinct(), "windows")
    counted = windows.groupBy("step").count().collect()  # a row for each shingle size, at most
    steps, fits = sorted(r["step"] for r in counted), sum(r["count"] for r in counted) <= BROADCAST_WINDOWS
    tokens = (
        windows.withColumn("list", F.split("words", " "))
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("step"))))
        .withColumn("token", F.expr("slice(list, at + 1, step)"))
        .select(
            "words",
            "size",
            "at",
            F.coalesce(
                *[
                    F.when(F.col("step") == n, _key([F.element_at("token", i + 1) for i in range(n)], n))
                    for n in steps
                ],
                F.lit(0).cast("long"),
            ).alias("token"),
        )
    )
    most = max(steps, default=1)
    listed = identified(docs).select("k1", "k2", words_of(F.col("text")).alias("w"))
    # zipped with itself shifted, each word stands beside those that follow it
    zipped = F.arrays_zip(
        F.col("w").alias("w0"), *[F.expr(f"slice(w, {n + 1}, size(w))").alias(f"w{n}") for n in range(1, most)]
    )
    laid = listed.where("size(w) > 0").select("k1", "k2", "w", F.posexplode(zipped).alias("pos", "near"))
    following = [F.col(f"near.w{n}") for n in range(most)]
    keys = [
        F.when(following[n - 1].isNotNull(), _key(following[:n], n)) for n in steps
    ]
    if len(keys) == 1:
        laid = laid.withColumn("token", keys[0])
    else:
        laid = laid.withColumn("token", F.explode(F.array(*keys)) if keys else F.lit(None).cast("long"))
    reach = window - 1
    met = stored(
        laid.join(_bounded(tokens.select("token").distinct(), fits), "token").select(
            "k1",
            "k2",
            "token",
            "pos",
            F.least("pos", F.lit(reach)).alias("before"),
            F.expr(
                f"array_join(slice(w, greatest(pos - {reach}, 0) + 1, least(pos, {reach}) + {window}), ' ')"
            ).alias("around"),
        ),
        "tokens-met",
    )
    frequency = met.groupBy("token").agg(F.count("*").alias("n"))
    # a window with a token that never occurs has n = null there, sorts first and meets nothing
    prefix = (
        tokens.join(frequency, "token", "left")
        .groupBy("words", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("rarest"))
        .where("rarest.n > 0")
        .select("words", "size", F.col("rarest.token").alias("token"), F.col("rarest.at").alias("at"))
    )
    return (
        met.join(_bounded(prefix, fits), "token")
        .where("before >= at")
        .withColumn("found", F.expr("slice(split(around, ' '), before - at + 1, size)"))
        .where("size(found) = size AND array_join(found, ' ') = words")
        .select("k1", "k2", (F.col("pos") - F.col("at")).alias("start"), "size", "words")
        .distinct()
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (sorted strings) for every row of ``docs``.

    ``docs`` needs ``doc_id, text``, ``benchmark`` ``item_id, text``; other columns are not read.
    A word is hit if it lies inside an occurrence of any window; overlaps count once. Null and
    empty texts have no words; items without words have no windows; an item of fewer than
    ``window`` words is one window. Items whose id is null hit but are not named. Repeated rows
    each get the result; an empty table on either side hits nothing.
    """
    found = stored(occurrences(docs, benchmark, window, shingle), "occurrences")
    spans = found.select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    earlier = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        spans.withColumn("upto", F.max("end").over(earlier))
        .select(
            "k1",
            "k2",
            F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("upto", F.lit(0)))).alias("new"),
        )
        .groupBy("k1", "k2")
        .agg(F.sum("new").alias("n_hit"))
    )
    naming = item_windows(benchmark, window, shingle).select("item_id", "words", "size")
    named = (
        found.select("k1", "k2", "words", "size").distinct()
        .join(naming, ["words", "size"])
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    of = hit.join(named, ["k1", "k2"], "left")
    counted = identified(docs).select(
        "doc_id", "k1", "k2", F.regexp_count(lowered(F.coalesce("text", F.lit(""))), F.lit(_WORD)).alias("n_words")
    )
    return counted.join(of, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs."""
    found = occurrences(docs, benchmark, window, shingle).select("k1", "k2").distinct()
    k1, k2 = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "text", "doc_id")
    hits = found.withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    return docs.join(hits, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
