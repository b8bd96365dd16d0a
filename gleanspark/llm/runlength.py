"""Long repeated strings in a corpus: run-length Burrows-Wheeler indexes over anchored stretches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.shared import byte_views, stored, utf8

LENGTH = 400  # bytes that must repeat
GRAM = 32  # bytes whose hash makes an anchor
SHARD_BYTES = 1 << 20  # of text in one index
_PIECE = 1 << 20  # bytes hashed together; an anchor's place takes the hash's low 20 bits
_PACK = 7  # symbols that begin the suffix order
_FINE = 8  # stretches into which a crowded anchor's starts are cut


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each place on, by doubling."""
    h, span = data.astype(np.uint64) + np.uint64(1), 1
    while span < gram:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15) + h[span:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        span *= 2
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least_of_next(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each value and the ``width - 1`` after it."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Cut all starts of ``length``-byte strings of adjoining texts into stretches with one anchor.

    A string's anchor is its gram of least hash, the first of equal ones, so equal strings have
    equal anchors at equal distance, wherever they stand. Returns, by stretch, the text, the
    first start (in all the data), how many starts follow each other, where the anchor lies
    after the first start, and the anchor's hash.
    """
    width, low = length - gram + 1, np.uint64(_PIECE - 1)
    out: list[tuple[np.ndarray, ...]] = []
    step = _PIECE - length
    for begin in range(0, len(data), step):
        piece = data[begin : begin + step + length - 1]
        if len(piece) < length:
            break
        hashes = gram_hashes(piece, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        anchor = (least_of_next((hashes & ~low) | place, width) & low).astype(np.int64)
        starts = np.arange(begin, begin + len(anchor))
        text = np.searchsorted(offsets, starts, "right") - 1
        fits = starts + length <= offsets[text + 1]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new & fits)
        ends = np.flatnonzero(fits & np.append(new[1:] | ~fits[1:], True))
        out.append((text[first], starts[first], ends - first + 1, anchor[first] - first, hashes[anchor[first]]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


STRETCHES = "k1 long, k2 long, anchor long, s1 long, s2 long, n int, at int, starts array<int>"


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The stretches of every text ``k1, k2, body``; equal ones of a text are one row with all starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = byte_views(batch.column(2))
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = np.fromiter(map(len, views), np.int64, len(views))
            for some in np.split(np.arange(len(views)), np.flatnonzero(np.diff(np.cumsum(sizes) // (4 * _PIECE))) + 1):
                joined = b"".join([views[i] for i in some])
                offsets = np.concatenate(([0], np.cumsum(sizes[some])))
                text, start, n, at, anchor = stretches(np.frombuffer(joined, np.uint8), offsets, length, gram)
                if not len(text):
                    continue
                digest = xxhash.xxh3_128_digest
                held = memoryview(joined)
                marks = np.frombuffer(
                    b"".join(
                        [digest(held[a : a + m]) for a, m in zip(start.tolist(), (n + length - 1).tolist(), strict=True)]
                    ),
                    np.int64,
                ).reshape(-1, 2)
                order = np.lexsort((start, marks[:, 0], anchor, text))
                text, start, n, at, anchor, marks = (c[order] for c in (text, start, n, at, anchor, marks))
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (marks[1:] != marks[:-1]).any(axis=1)
                first = np.flatnonzero(new)
                rows = some[text[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1[rows]),
                        pa.array(k2[rows]),
                        pa.array(anchor[first].view(np.int64)),
                        pa.array(marks[first, 0]),
                        pa.array(marks[first, 1]),
                        pa.array(n[first].astype(np.int32)),
                        pa.array(at[first].astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(first, len(text)).astype(np.int32)),
                            pa.array((start - offsets[text]).astype(np.int32)),
                        ),
                    ],
                    [c.split()[0] for c in STRETCHES.split(", ")],
                )

    return texts.mapInArrow(run, STRETCHES)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with suffixes sampled at run ends.

    The texts are laid one after another, each closed by a mark of its own, so no match crosses
    from one to the next. Kept are the runs' first places in the transform (``heads``), their
    ``symbols``, and for every border between two runs the suffixes on either side.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.total = int((sizes + 1).sum())
        symbols = np.zeros(self.total, np.int16)
        own = np.ones(self.total, bool)
        own[self.begins + sizes] = False
        symbols[own] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
        self.symbols_of, self.text_of = symbols, np.repeat(np.arange(len(texts)), sizes + 1)
        self.ends = self.begins + sizes
        order = self._suffixes(symbols)
        before = np.where(order > 0, symbols[order - 1], 0)
        before[np.isin(order, self.begins, assume_unique=True)] = 0
        # closing marks differ from one another, so each is a run of its own
        border = np.ones(self.total, bool)
        border[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(border)
        self.symbols = before[self.heads]
        self.starts_run = order[self.heads]
        self.ends_run = order[self.heads[1:] - 1]  # the last suffix of the run before each border
        self.last = order[-1:]

    def _suffixes(self, symbols: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; only suffixes not yet told apart are sorted again."""
        n = self.total
        distance = self.ends[self.text_of] - np.arange(n)  # to the closing mark
        key = np.zeros(n, np.int64)
        for k in range(_PACK):
            key <<= 9
            m = max(0, n - k)
            key[:m] |= np.where(distance[:m] > k, symbols[k : k + m], 0)
        order = np.lexsort((np.where(distance < _PACK, self.text_of, -1), key))
        k_sorted, t_sorted = key[order], np.where(distance < _PACK, self.text_of, -1)[order]
        new = np.ones(n, bool)
        new[1:] = (k_sorted[1:] != k_sorted[:-1]) | (t_sorted[1:] != t_sorted[:-1])
        first = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))
        covered = _PACK
        while True:
            last = np.append(new[1:], True)
            open_places = np.flatnonzero(~(new & last))
            if not len(open_places):
                return order
            some = order[open_places]
            after = some + covered
            second = np.where(after < n, rank[np.minimum(after, n - 1)], 0)
            by = np.lexsort((second, rank[some]))
            some, second = some[by], second[by]
            order[open_places] = some
            mine = rank[some]
            cut = np.ones(len(some), bool)
            cut[1:] = (mine[1:] != mine[:-1]) | (second[1:] != second[:-1])
            new[open_places] = cut
            group = np.flatnonzero(cut)
            rank[some] = np.repeat(open_places[group], np.diff(np.append(group, len(some))))
            covered *= 2

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to the end of either text."""
        room = np.minimum(self.ends[self.text_of[left]] - left, self.ends[self.text_of[right]] - right)
        out, todo = np.zeros(len(left), np.int64), np.flatnonzero(room > 0)
        step = 32
        padded = np.concatenate((self.symbols_of, np.zeros(step, np.int16)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, step)
        while len(todo):
            same = windows[left[todo] + out[todo]] == windows[right[todo] + out[todo]]
            run = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
            out[todo] = np.minimum(out[todo] + run, room[todo])
            todo = todo[(run == step) & (out[todo] < room[todo])]
        return out

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of starts whose next ``length`` bytes occur elsewhere: text, first, last.

        The matching statistic of a place is its longest common prefix with the suffix before or
        after it in the order. Inside a run it is one less than at the place before, so it is
        measured at run borders only, by the sampled suffixes, and streamed along the texts.
        """
        lcp = self.common(self.starts_run[1:], self.ends_run)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # once by the suffix before a run's first, once by the suffix after a run's last
        for places, values in (
            (self.starts_run, np.concatenate(([0], lcp))),
            (np.concatenate((self.ends_run, self.last)), np.concatenate((lcp, [0]))),
        ):
            by = np.argsort(places, kind="stable")
            places, values = places[by], values[by]
            until = np.append(places[1:], self.total)
            reach = np.minimum(until, places + values - length + 1)
            good = np.flatnonzero((values >= length) & (reach > places))
            found.append((places[good], reach[good] - 1))
        first, last = (np.concatenate(c) for c in zip(*found, strict=True))
        text = self.text_of[first]
        return text, first - self.begins[text], last - self.begins[text]


MARKS = "anchor long, s1 long, s2 long, lo int, hi int"


def _index_marks(work: DataFrame, length: int, shard_bytes: int, total: int) -> DataFrame:
    """Marks of texts ``anchor, s1, s2, w, body`` by one index for each shard of whole anchors."""

    def marks(shard: pd.DataFrame) -> pd.DataFrame:
        texts = [bytes(t) for t in shard["body"]]
        text, first, last = RunLengthIndex(texts).repeated(length)
        # a text that stands in several places occurs elsewhere from end to end
        whole = np.flatnonzero(shard["w"].to_numpy() > 1)
        text = np.concatenate((text, whole))
        lo = np.concatenate((first, np.zeros(len(whole), np.int64)))
        hi = np.concatenate((last, np.array([len(texts[i]) - length for i in whole], np.int64)))
        return pd.DataFrame(
            {c: shard[c].to_numpy()[text] for c in ("anchor", "s1", "s2")} | {"lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}
        )

    shards = max(1, -(-total // shard_bytes))
    spread = work.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return spread.groupBy("shard").applyInPandas(marks, MARKS)


_FINER = "anchor long, s1 long, s2 long, base int, key long, d1 long, d2 long, w long, body binary"


def _finer(work: DataFrame, length: int, gram: int) -> DataFrame:
    """Cut texts of crowded anchors by their starts' distance from the anchor. The bytes common to
    all strings that start within one such stretch take the anchor's part."""
    reach = length - gram
    width = -(-(reach + 1) // _FINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for anchor, s1, s2, at, w, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = len(body) - length
                for part in range(_FINE):
                    low, high = part * width - reach, min(0, (part + 1) * width - 1 - reach)
                    a, z = max(0, at + low), min(last, at + high)
                    if a <= z:
                        core = body[at + high : at + low + length]
                        key = xxhash.xxh64_intdigest(core, part) - (1 << 63)
                        text = body[a : z + length]
                        mark = np.frombuffer(xxhash.xxh3_128_digest(text), np.int64).tolist()
                        rows.append((anchor, s1, s2, a, key, *mark, w, text))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    [c.split()[0] for c in _FINER.split(", ")],
                )

    return work.select("anchor", "s1", "s2", "at", "w", "body").mapInArrow(run, _FINER)


def _each_start(work: DataFrame, length: int) -> DataFrame:
    """Marks of texts still crowded: every string by itself, counted by its digest."""
    strings = work.select(
        "anchor", "s1", "s2", "w", "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - length)).alias("lo")
    ).select(
        "anchor",
        "s1",
        "s2",
        "w",
        "lo",
        F.md5(F.substring("body", F.col("lo") + 1, F.lit(length))).alias("d"),
    )
    often = strings.groupBy("d").agg(F.sum("w").alias("total")).where("total > 1").select("d")
    return strings.join(often, "d").select("anchor", "s1", "s2", F.col("lo").cast("int"), F.col("lo").cast("int").alias("hi"))


def _crowded_marks(work: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """Marks under anchors whose texts are too many for one index."""
    items = stored(_finer(work, length, gram), "finer")
    distinct = items.groupBy("key", "d1", "d2").agg(F.sum("w").alias("w"), F.min("body").alias("body"))
    kinds = distinct.groupBy("key").agg(
        F.count("*").alias("kinds"), F.sum("w").alias("total"), F.sum(F.octet_length("body")).alias("bytes")
    )
    parts = stored(
        distinct.join(kinds.where("total > 1"), "key").select(
            F.col("key").alias("anchor"), F.col("d1").alias("s1"), F.col("d2").alias("s2"), "w", "body", "kinds", "bytes"
        ),
        "finer-parts",
    )
    single = parts.where("kinds = 1").select(
        "anchor", "s1", "s2", F.lit(0).alias("lo"), (F.octet_length("body") - length).alias("hi")
    )
    some = parts.where(F.col("kinds") > 1)
    small = some.where(F.col("bytes") <= shard_bytes)
    total = small.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    marks = (
        single.union(_index_marks(small.select("anchor", "s1", "s2", "w", "body"), length, shard_bytes, total))
        .union(_each_start(some.where(F.col("bytes") > shard_bytes), length))
        .select(F.col("anchor").alias("key"), F.col("s1").alias("d1"), F.col("s2").alias("d2"), "lo", "hi")
    )
    return (
        items.select("anchor", "s1", "s2", "base", "key", "d1", "d2")
        .join(marks, ["key", "d1", "d2"])
        .select("anchor", "s1", "s2", (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    )


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``k1, k2, spans``: byte ranges (first, end) of each text that a repeated string covers.

    ``texts`` has ``k1, k2`` (two longs that stand for the row) and ``body`` (binary). Strings
    meet under their anchors: text whose anchors occur once is never moved. Under each repeated
    anchor every different stretch is kept once, with its number. Where an anchor has a single
    stretch there is nothing to tell apart; the others go, whole anchors together, into shards
    of bounded bytes, and a run-length index of each shard gives the matches of all its
    stretches, which include every string of ``length`` bytes under its anchors in the corpus.
    Anchors whose stretches are too many for a shard are divided by longer common parts.
    """
    cut = stored(anchored(texts, length, gram), "stretches")
    often = cut.groupBy("anchor").agg(F.sum(F.size("starts")).alias("total")).where("total > 1").select("anchor")
    held = stored(cut.join(often, "anchor", "left_semi"), "stretches-met")
    distinct = held.groupBy("anchor", "s1", "s2").agg(
        F.sum(F.size("starts")).alias("w"),
        F.min(F.struct("k1", "k2", F.element_at("starts", 1).alias("start"), "n", "at")).alias("one"),
    )
    kinds = held.groupBy("anchor", "s1", "s2").agg(F.max("n").alias("n")).groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.sum(F.col("n") + (length - 1)).alias("bytes")
    )
    parts = stored(distinct.join(kinds, "anchor"), "stretches-distinct")
    single = parts.where("kinds = 1").select(
        "anchor", "s1", "s2", F.lit(0).alias("lo"), (F.col("one.n") - 1).alias("hi")
    )
    asked = parts.where("kinds > 1").select("anchor", "s1", "s2", "w", "bytes", "one.*")
    work = stored(
        texts.join(asked, ["k1", "k2"]).select(
            "anchor",
            "s1",
            "s2",
            "w",
            "at",
            "bytes",
            F.substring("body", F.col("start") + 1, F.col("n") + (length - 1)).alias("body"),
        ),
        "stretch-texts",
    )
    small, crowd = work.where(F.col("bytes") <= shard_bytes), work.where(F.col("bytes") > shard_bytes)
    total = small.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    marks = single.union(_index_marks(small.select("anchor", "s1", "s2", "w", "body"), length, shard_bytes, total))
    if not crowd.isEmpty():
        marks = marks.union(_crowded_marks(crowd, length, gram, shard_bytes))
    laid = held.join(marks, ["anchor", "s1", "s2"]).select("k1", "k2", F.explode("starts").alias("start"), "lo", "hi")
    return laid.groupBy("k1", "k2").agg(
        F.collect_set(
            F.struct((F.col("start") + F.col("lo")).alias("first"), (F.col("start") + F.col("hi") + length).alias("end"))
        ).alias("spans")
    )


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) for every row of ``docs``.

    Removed is each byte of the UTF-8 ``text`` covered by a string of ``length`` bytes that starts
    at another place too, in the same text or another; all strings are judged on the input.
    Reads ``doc_id`` (long) and ``text`` alone. Null and empty texts have no bytes; a text shorter
    than ``length`` is kept. Repeated rows are each other's repeats. A cut may fall inside a
    character, so ``kept`` is binary. An empty table gives no rows.
    """
    texts = docs.select(
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2"),
        utf8(F.col("text")).alias("body"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )
    spans = repeated_spans(texts.select("k1", "k2", "body"), length, gram, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, rows = byte_views(batch.column(1)), []
            for doc, body, spans in zip(batch.column(0).to_pylist(), views, batch.column(2), strict=True):
                if not spans.is_valid or not len(body):
                    rows.append((doc, len(body), 0, 0, bytes(body)))
                    continue
                first, end = (spans.values.field(i).to_numpy() for i in (0, 1))
                edge = np.zeros(len(body) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = int(gone[0]) + np.count_nonzero(gone[1:] & ~gone[:-1])
                rows.append(
                    (doc, len(body), int(gone.sum()), int(begins), np.frombuffer(body, np.uint8)[~gone].tobytes())
                )
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                [c.split()[0] for c in CUT.split(", ")],
            )

    return texts.join(spans, ["k1", "k2"], "left").select("doc_id", "body", "spans").mapInArrow(run, CUT)
