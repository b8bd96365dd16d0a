"""Divergence of sources by their term frequencies, from run-length columns of a reordered vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.shared import byte_views, stored, utf8

SCALE = 1_000_000_000
HELD = 300_000  # terms a task counts before it hands them on
BLOCK_TERMS = 4096  # terms of a language whose columns meet in one task, on average
TILE_SOURCES = 128  # sources from either side that meet in one task
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # bytes of UTF-8, lower-cased: letters of ASCII and all beyond it


def term_counts(docs: DataFrame, held_terms: int = HELD) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of every term and documents that hold it; a row
    with a null term for every group, so groups without terms are there too."""
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*groups, utf8(F.col("text")).alias("body"))

    def handed(held: dict) -> pa.RecordBatch:
        rows = [(*g, None, 0, 0) for g in held]
        rows += [(*g, t, n, found[t]) for g, (counts, found) in held.items() for t, n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(made, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, body in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_views(batch.column(2)), strict=True
            ):
                counts, found = held.setdefault((lang, source), (Counter(), Counter()))
                terms = _TERM.findall(bytes(body).lower())
                counts.update(terms)
                found.update(set(terms))
            if sum(len(counts) for counts, _ in held.values()) > held_terms:
                yield handed(held)
                held = {}
        yield handed(held)

    made = texts.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    made = made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return made.withColumn("term", F.col("term").cast("string"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, by long division in 64 bits; exact
    while the divisor is below 9 * 10^15."""
    divisor = total + 2 * terms
    if divisor > 9_000_000_000_000_000:
        raise OverflowError("more occurrences of one language than exact division holds")
    left, out = counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):  # SCALE is 1000 three times; the rest stays below the divisor
        out = out * 1000 + left * 1000 // divisor
        left = left * 1000 % divisor
    return out + 1


def reordered(counts: np.ndarray) -> np.ndarray:
    """An order of the terms (columns) in which equal counts of the sources (rows) lie together:
    sorted by the source with the fewest different counts first."""
    kinds = np.array([len(np.unique(row)) for row in counts])
    return np.lexsort(counts[np.argsort(-kinds, kind="stable")])


def runs(row: np.ndarray) -> np.ndarray:
    """Where the runs of equal counts start."""
    return np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))


def f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_value(some: tuple, other: tuple, terms: int) -> int:
    """Sum of f over the terms for two sources given by the starts of their runs and the shares in them."""
    bounds = np.union1d(some[0], other[0])
    p = some[1][np.searchsorted(some[0], bounds, "right") - 1]
    q = other[1][np.searchsorted(other[0], bounds, "right") - 1]
    return int((f_of(p, q) * np.diff(bounds, append=terms)).sum())


def _cell(part: pd.DataFrame, top: int, tile: int) -> pd.DataFrame:
    """Pair sums and leading terms of one block of the vocabulary and two tiles of sources."""
    mark = part["term"].isna().to_numpy()
    groups = part[mark].sort_values("at")
    at = groups["at"].to_numpy()
    i, j, lang, words = int(part["i"].iloc[0]), int(part["j"].iloc[0]), part["lang"].iloc[0], int(groups["words"].iloc[0])
    names, totals = groups["source"].to_numpy(), groups["total"].to_numpy()
    rows = part[~mark]
    codes, named = pd.factorize(rows["term"])
    size = int(groups["size"].iloc[0])  # terms of the block that no source here has are columns of zeros
    found = np.full(size, None, object)
    found[: len(named)] = named
    counts = np.zeros((len(groups), size), np.int64)
    counts[np.searchsorted(at, rows["at"].to_numpy()), codes] = rows["n"].to_numpy()
    everywhere = np.zeros(size, np.int64)
    everywhere[codes] = rows["everywhere"].to_numpy()
    order = reordered(counts) if size else np.zeros(0, np.int64)
    counts, everywhere, found = counts[:, order], everywhere[order], found[order]
    out: list[tuple] = []
    columns = []
    for k in range(len(groups)):
        starts = runs(counts[k]) if len(found) else np.zeros(0, np.int64)
        columns.append((starts, shares(counts[k][starts], int(totals[k]), words) if words else starts))
    for a in range(len(groups)):
        for b in range(a + 1, len(groups)):
            if i == j or (at[a] // tile, at[b] // tile) == (i, j):
                value = pair_value(columns[a], columns[b], len(found)) if len(found) else 0
                out += [(names[a], "pair", names[b], value), (names[b], "pair", names[a], value)]
    if i == j and len(found):
        q = shares(everywhere, int(groups["spoken"].iloc[0]), words)
        for k, (starts, share) in enumerate(columns):
            p = np.repeat(share, np.diff(starts, append=len(found)))
            more = np.flatnonzero((counts[k] > 0) & (p > q))
            value = f_of(p[more], q[more])
            if len(more) > top:  # ties with the last one stay, so the names can decide
                least = np.partition(value, -top)[-top]
                more, value = more[value >= least], value[value >= least]
            best = sorted(zip(value.tolist(), found[more], strict=True), key=lambda x: (-x[0], x[1].encode()))
            out += [(names[k], "term", term, v) for v, term in best[:top]]
    made = pd.DataFrame(out, columns=["source", "part", "item", "value"])
    made.insert(0, "lang", lang)
    return made.astype({"value": "int64"})


def source_divergence(
    docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = BLOCK_TERMS, tile: int = TILE_SOURCES, held: int = HELD
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how sources of a language differ in their terms.

    Terms are runs of letters of ASCII, lower-cased, and of characters beyond it; a language keeps
    those that at least ``min_docs`` of its documents hold. A term's share in a source or in the
    language is ``1 + floor(10^9 (count + 2) / (N + 2 V))``, and ``f = floor((p - q)^2 / (p + q))``.
    Part ``pair`` gives the sum of f for every two sources of a language, part ``term`` the ``top``
    terms a source uses more than the language. Both are ranked by value, then by item.

    The vocabulary is cut into blocks of ``block`` terms by hash, the sources into tiles of ``tile``. In each cell of a block and
    two tiles the terms are put in an order that brings equal counts together, every source is a
    run-length column, and a pair takes f once for each stretch between two run boundaries. A
    language's vocabulary and a hot source are thus spread over many tasks. The rows for pairs are
    as many as the result has, times the blocks, before they are summed.

    Null text, lang and source are empty strings; a group without terms is there with counts of 0;
    a language without kept terms has values of 0; repeated rows count each; an empty table gives
    no rows; other columns are not read.
    """
    counted = stored(term_counts(docs, held), "term-counts")
    terms = counted.where("term IS NOT NULL")
    vocabulary = (
        terms.groupBy("lang", "term")
        .agg(F.sum("n").alias("everywhere"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    kept = stored(terms.drop("docs").join(vocabulary, ["lang", "term"]), "terms-kept")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("words"), F.sum("everywhere").alias("spoken"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        counted.where("term IS NULL")
        .select("lang", "source")
        .join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "words", "spoken"])
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("int"))
        .withColumn("tiles", F.ceil(F.col("sources") / tile).cast("int"))
        .drop("sources")
    )
    groups = stored(groups, "sources")
    laid = kept.join(groups.select("lang", "source", "at", "parts", "tiles"), ["lang", "source"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    )
    sizes = (
        vocabulary.join(groups.select("lang", "parts").distinct(), "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
        .groupBy("lang", "block")
        .agg(F.count("*").alias("size"))
    )
    marks = (
        groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(sizes, ["lang", "block"], "left")
        .na.fill(0, ["size"])
    )
    both = laid.unionByName(marks, allowMissingColumns=True)
    own = F.floor(F.col("at") / tile).cast("int")
    cells = (
        both.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"i": F.least(own, F.col("with")), "j": F.greatest(own, F.col("with"))})
        .drop("parts", "tiles", "with")
    )
    found = cells.groupBy("lang", "block", "i", "j").applyInPandas(
        lambda part: _cell(part, top, tile), "lang string, source string, part string, item string, value long"
    )
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= top))
