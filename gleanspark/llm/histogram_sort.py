"""Sharding by histogram sort: exact byte counts below probed keys, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.shared import stored

PROBES = 32  # keys tried for each open splitter in a round
TOLERANCE = 0.001  # of a shard's bytes, by which a splitter may miss its mark
PART_BYTES = 96 << 20  # of rows in one task of the exchange
_SPAN = 1 << 64


def sort_key(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Key of a row in two longs: equal texts lie together, and the id parts them."""
    return F.xxhash64(text), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def _words(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 128 bits as two arrays of 64."""
    return np.array([k >> 64 for k in keys], np.uint64), np.array([k % _SPAN for k in keys], np.uint64)


def _unsigned(longs: np.ndarray) -> np.ndarray:
    """Longs in their own order, moved to begin at zero."""
    return longs.view(np.uint64) ^ np.uint64(1 << 63)


def places(high: np.ndarray, low: np.ndarray, keys: list[int]) -> np.ndarray:
    """For each row, how many of the sorted distinct ``keys`` are at or below it."""
    key_high, key_low = _words(keys)
    at = np.searchsorted(key_high, high, "left")
    tied = np.flatnonzero(at < np.searchsorted(key_high, high, "right"))
    for h in np.unique(high[tied]):
        rows = tied[high[tied] == h]
        first, last = np.searchsorted(key_high, h, "left"), np.searchsorted(key_high, h, "right")
        at[rows] = first + np.searchsorted(key_low[first:last], low[rows], "right")
    return at


def histogram(keyed: DataFrame, keys: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Exact bytes, rows, and least and largest key of the rows between neighbouring keys.

    Each task reports one row per stretch it has rows in, so what reaches the driver is bounded
    by the probes, not by the data.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys) + 1
        total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends: dict[int, tuple[int, int]] = {}
        for batch in batches:
            high, low = (_unsigned(batch.column(c).to_numpy()) for c in (0, 1))
            size, at = batch.column(2).to_numpy(), places(high, low, keys)
            np.add.at(total, at, size)
            rows += np.bincount(at, minlength=n)
            order = np.lexsort((low, high, at))
            cut = np.flatnonzero(np.diff(at[order], prepend=-1))
            for first, last in zip(cut, np.append(cut[1:], len(order)) - 1, strict=True):
                a, z = ((int(high[order[i]]) << 64) + int(low[order[i]]) for i in (first, last))
                old = ends.get(int(at[order[first]]), (a, z))
                ends[int(at[order[first]])] = (min(a, old[0]), max(z, old[1]))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some),
                pa.array(total[some]),
                pa.array(rows[some]),
                pa.array([f"{ends[i][0]:032x}" for i in some.tolist()], pa.string()),
                pa.array([f"{ends[i][1]:032x}" for i in some.tolist()], pa.string()),
            ],
            ["at", "bytes", "n", "low", "high"],
        )

    counted = keyed.select("h", "d", "size").mapInArrow(count, "at long, bytes long, n long, low string, high string")
    merged = counted.groupBy("at").agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return {r["at"]: (r["bytes"], r["n"], int(r["low"], 16), int(r["high"], 16)) for r in merged.collect()}


def splitters(keyed: DataFrame, parts: int, tolerance: float, probes: int = PROBES) -> list[int]:
    """``parts - 1`` keys that cut the rows into parts of equal bytes.

    Every round counts the exact bytes below all probes. A splitter is settled by the probe that
    meets its mark within the tolerance, or when no key is left between the probes around the
    mark; then the nearer of the two is taken. Others get new probes, spread over the keys seen
    between those around the mark.
    """
    whole = histogram(keyed, [])
    if not whole:
        return [0] * (parts - 1)
    total, _, least, most = whole[0]
    marks = [total * k // parts for k in range(1, parts)]
    slack = tolerance * total / parts
    # around each mark: a key with the bytes below it, and the next key that is too high
    around = [((least, 0), (most + 1, total)) for _ in marks]
    found: list[int | None] = [None] * len(marks)
    while None in found:
        tried: set[int] = set()
        for k, (low, high) in enumerate(around):
            if found[k] is not None:
                continue
            for (key, below), (other, beyond) in ((low, high), (high, low)):
                if abs(below - marks[k]) <= slack:
                    found[k] = key
            if found[k] is None and high[0] - low[0] <= 1:
                found[k] = min(low, high, key=lambda side: abs(side[1] - marks[k]))[0]
            if found[k] is None:
                gap = high[0] - low[0]
                tried |= {low[0] + max(1, gap * i // (probes + 1)) for i in range(1, probes + 1)} - {high[0]}
        if not tried:
            break
        keys = sorted(tried)
        stretch = histogram(keyed, keys)
        below = np.cumsum([stretch.get(i, (0,))[0] for i in range(len(keys) + 1)]).tolist()
        for k, mark in enumerate(marks):
            if found[k] is not None:
                continue
            low, high = around[k]
            for i, key in enumerate(keys):
                if low[0] < key < high[0]:
                    if below[i] <= mark:
                        # rows from here on begin at the first key seen beyond the probe
                        seen = stretch.get(i + 1)
                        low = (min(max(key, seen[2]) if seen else key, high[0]), below[i])
                    else:
                        high = (key, below[i])
                        break
            around[k] = (low, high)
    return [int(f) for f in found]


def histogram_shards(
    docs: DataFrame,
    size: Column,
    shards: int,
    tolerance: float = TOLERANCE,
    part_bytes: int = PART_BYTES,
    probes: int = PROBES,
) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Rows are sorted by hash of ``text``, then ``doc_id``, and cut where the bytes (``size``, which
    must not be null) are equal up to the tolerance. Copies of a text lie together and are cut
    apart only where a shard ends, so a text with a third of all rows spreads over as many
    shards as its bytes ask for. Rows equal in text and doc_id can't be parted. A shard is made of several parts
    of bounded bytes, each sorted in one task of the single exchange; a row's slot is its place
    there after the counted rows of the parts before. Null texts hash like one text; null
    doc_ids sort first. An empty table gives no rows.
    """
    taken = {"__h", "__d", "__size", "__part"}
    if taken & set(docs.columns):
        raise ValueError(f"columns {sorted(taken & set(docs.columns))} are used here")
    h, d = sort_key(F.col("text"), F.col("doc_id"))
    rows = docs.withColumns({"__h": h, "__d": d, "__size": size.cast("long")})
    keyed = stored(rows.select(F.col("__h").alias("h"), F.col("__d").alias("d"), F.col("__size").alias("size")), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-total // (shards * part_bytes)))
    cuts = splitters(keyed, shards * each, tolerance / each, probes)
    # equal cuts leave the parts between them empty; a row is past all of them together
    keys = sorted(set(cuts))
    upto = np.searchsorted(np.array(cuts, object), np.array([*keys, _SPAN * _SPAN], object), "left")

    @F.arrow_udf("int")
    def part(high: pa.Array, low: pa.Array) -> pa.Array:
        at = places(_unsigned(high.to_numpy()), _unsigned(low.to_numpy()), keys)
        return pa.array(upto[at].astype(np.int32))

    counts = {int(upto[i]): n for i, (_, n, _, _) in histogram(keyed, keys).items()}
    before, seen = [], 0
    for p in range(shards * each):
        seen = 0 if p % each == 0 else seen
        before.append(seen)
        seen += counts.get(p, 0)
    dealt = rows.withColumn("__part", part("__h", "__d")).repartition(shards * each, "__part")
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__h", "__d"))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__part") + 1)
    return dealt.withColumns(
        {"shard": F.expr(f"__part div {each}").cast("int"), "slot": own.cast("long") - 1 + offset}
    ).drop(*taken)
