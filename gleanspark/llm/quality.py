"""Quality classifier by positive-unlabelled learning with the non-negative risk estimate."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.shared import byte_views, utf8

SAMPLE_ROWS = 8_000  # of trusted positives, and twice as many of unlabelled texts, at most
THRESHOLD = 0.7
_MARKS = b"!?.,;:|#%$&*\"'()<>=/\\_-@^~+[]{}"
_HEAD = 1 << 14  # bytes at a time for the compressed size


def features(text: bytes) -> np.ndarray:
    """Shares and shapes of a whole text; nothing but the text goes in."""
    data = np.frombuffer(text, np.uint8)
    n = max(1, len(data))
    at = np.bincount(data, minlength=256)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line]
    m = max(1, len(words))
    counts = Counter(words)
    top = sorted(counts.values())[-5:]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    same = sum(map(bytes.__eq__, words[1:], words[:-1])) if words else 0
    capital = at[65:91].sum()
    small = at[97:123].sum()
    packed, squeeze = 0, zlib.compressobj(1)
    for k in range(0, len(text), _HEAD):
        packed += len(squeeze.compress(text[k : k + _HEAD]))
    packed += len(squeeze.flush())
    ends = np.fromiter((w[-1] for w in words), np.uint8, len(words))
    return np.array(
        [
            np.log1p(len(data)),
            np.log1p(len(words)),
            capital / n,
            small / n,
            capital / max(1, capital + small),
            at[48:58].sum() / n,
            at[128:].sum() / n,
            (at[9:14].sum() + at[32]) / n,
            at[:9].sum() / n,
            *[at[c] / m for c in _MARKS],
            lengths.mean() if len(words) else 0,
            lengths.std() if len(words) else 0,
            (lengths > 20).sum() / m,
            len(counts) / m,
            len(counts) / np.sqrt(m),
            top[-1] / m if top else 0,
            sum(top) / m,
            same / m,
            sum(w.isupper() for w in words) / m,
            sum(w.isalpha() for w in words) / m,
            np.isin(ends, np.frombuffer(b".!?", np.uint8)).sum() / m,
            len(lines) / m,
            1 - len(set(lines)) / max(1, len(lines)),
            packed / n,
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(expanded((x - self.mean) / self.scale) @ self.weights, -30, 30)))


def expanded(z: np.ndarray) -> np.ndarray:
    """Features, how far each lies out on either side, and a constant."""
    z = np.clip(z, -6, 6)
    return np.concatenate((z, np.maximum(0, np.abs(z) - 1.5), np.ones((len(z), 1))), axis=1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, decay: float = 2e-3) -> Model:
    """Minimise the non-negative positive-unlabelled risk of a linear score with logistic loss.

    Risk = prior E+[l(s)] + max(0, Eu[l(-s)] - prior E+[l(-s)]). Where the second part falls
    below zero the step climbs back on it alone, so the fit can't profit from a negative risk.
    """
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = expanded((positive - mean) / scale), expanded((unlabelled - mean) / scale)
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        sp = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30)))
        su = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        for_positive = -prior * (1 - sp) @ p / len(p)
        for_negative = su @ u / len(u) - prior * sp @ p / len(p)
        gradient = for_positive + for_negative if negative >= 0 else -for_negative
        gradient[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.05 * (1 - 0.9 * step / steps)
        w -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def features_of(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([features(bytes(t)) for t in byte_views(texts)], pa.list_(pa.float64()))

    return rows(utf8(text))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _matrix(rows: DataFrame) -> np.ndarray:
    # bounded by the sample's size
    return np.array([r[0] for r in rows.select(features_of(F.col("text"))).collect()], np.float64)


def _some(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of their id; never above a quarter more."""
    share = max(1, -(-rows.count() // most))
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(share)) == 0).limit(most + most // 4)


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, prior: float | None = None
) -> Model | None:
    """Fit on labels of rows that are not held out: trusted positives against unlabelled texts.

    The fit takes a bounded sample, by hash of the id: ``sample_rows`` positives and twice as
    many texts of any kind as the unlabelled ones, whose labels are not looked at. The class
    prior is the share of positives among all labelled rows that are not held out, unless given.
    A document with a label other than 1 is no trusted positive. Without any positive there is
    no model.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    tally = known.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("ones")).first()
    if not tally["ones"]:
        return None
    if prior is None:
        prior = tally["ones"] / tally["n"]
    prior = min(0.99, max(0.01, prior))
    texts = docs.select("doc_id", "text")
    # at most the sample's ids, so small enough to send to all tasks
    ids = F.broadcast(_some(known.where("quality = 1").select("doc_id"), sample_rows))
    positive = _matrix(texts.join(ids, "doc_id").limit(2 * sample_rows))
    open_rows = texts.where(~held_out(F.col("doc_id")))
    unlabelled = _matrix(_some(open_rows, 2 * sample_rows))
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, prior)


def quality_scores(text: Column, model: Model | None) -> Column:
    """Probability that a whole text is of good quality; only the text is looked at. Null is
    scored as an empty text. Without a model every score is one half."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        views = byte_views(texts)
        if model is None or not views:
            return pa.array(np.full(len(views), 0.5))
        return pa.array(model.score(np.array([features(bytes(t)) for t in views])))

    return score(utf8(text))


def quality_of(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Needs ``doc_id, text`` and ``labels`` with ``doc_id, quality``; other columns are not read.
    Empty texts are scored too. Repeated rows get equal scores. Empty ``docs`` give no rows;
    without labels all scores are one half and ``predicted`` is 0. Rows without a doc_id are
    scored, count as not held out and carry no label.
    """
    model = train(docs, labels, **training)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_scores(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training: int) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    model = train(docs, labels, **training)
    if model is None:
        return docs
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    score = quality_scores(F.col(names[docs.columns.index("text")]), model)
    return rows.withColumn("__score", score).where(F.col("__score") >= threshold).select(*names).toDF(*docs.columns)
