"""Byte-level BPE over rank files: texts to token ids and back, in numpy matrices inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanspark.llm.shared import byte_views, flat_offsets, utf8

REMEMBERED = 150_000  # pieces after which a worker's memory of their ids starts anew
_TEXTS = 256  # texts encoded together
_NONE = np.int64(1 << 40)  # rank of a pair that no token joins
_ROWS = 1 << 18  # symbols of one padded matrix


class PairTable:
    """Pairs of token ids to the id of the joined token: open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] < 0
            claims, first = np.unique(at[free], return_index=True)
            placed = todo[free][first]
            self.keys[claims], self.values[claims] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The joined ids, ``_NONE`` where no token joins the pair."""
        shape, keys = keys.shape, keys.reshape(-1)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        todo = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        at = slots[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (seen >= 0)
            todo, at = todo[on], at[on]
        return out.reshape(shape)


class BytePairs:
    """A rank file with its splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern).findall
        self.width = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.width
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary has a token for each byte")
        left, right, joined = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        self.pairs = PairTable(np.array(left, np.int64) * self.width + np.array(right, np.int64), np.array(joined))
        self._forget()

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows of a padded matrix to the end; padding is -1.

        Each round takes every row's least rank and merges its pairs of that rank from the left,
        up to and including the first after which a pair of lower rank turns up (one at least):
        just those that merging the leftmost least pair, again and again, would come to next.
        Rows close up behind the merges; finished rows leave the matrix.
        """
        out, out_lengths = np.full_like(symbols, -1), lengths.copy()
        rows = np.arange(len(symbols))
        while len(rows):
            wide = int(lengths.max())
            symbols = symbols[:, :wide]
            a, b = symbols[:, :-1], symbols[:, 1:]
            joined = np.where(b >= 0, self.pairs.find(np.where(b >= 0, a * self.width + b, 0)), _NONE)
            least = joined.min(axis=1) if joined.shape[1] else np.full(len(rows), _NONE)
            done = least == _NONE
            if done.any():
                out[rows[done], :wide] = symbols[done]
                out_lengths[rows[done]] = lengths[done]
                on = ~done
                rows, symbols, lengths, joined, least = rows[on], symbols[on], lengths[on], joined[on], least[on]
                if not len(rows):
                    break
            hit = joined == least[:, None]
            # of touching hits every second one counts, from the left of their run
            at = np.arange(hit.shape[1])
            gap = np.maximum.accumulate(np.where(hit, -1, at[None, :]), axis=1)
            hit &= (at[None, :] - gap) % 2 == 1
            r, c = np.nonzero(hit)
            fused = least[r]
            before = np.flatnonzero(np.concatenate(([False], (r[1:] == r[:-1]) & (c[1:] == c[:-1] + 2))))
            left = np.where(c > 0, symbols[r, np.maximum(c - 1, 0)], -1)
            left[before] = fused[before]  # the pair just merged stands to its left
            has = c + 2 < lengths[r]
            right = np.where(has, symbols[r, np.minimum(c + 2, symbols.shape[1] - 1)], -1)
            lower = np.zeros(len(r), bool)
            for first, second, real in ((left, fused, left >= 0), (fused, right, right >= 0)):
                new = self.pairs.find(np.where(real, first * self.width + second, 0))
                lower |= real & (new < fused)
            stops = np.zeros(len(symbols), np.int64)
            stops[:] = hit.shape[1]
            np.minimum.at(stops, r[lower], c[lower])
            go = c <= stops[r]
            r, c, fused = r[go], c[go], fused[go]
            symbols = symbols.copy()
            symbols[r, c] = fused
            keep = np.arange(wide)[None, :] < lengths[:, None]
            keep[r, c + 1] = False
            lengths = keep.sum(axis=1)
            close = np.full_like(symbols, -1)
            to_row, from_col = np.nonzero(keep)
            start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            close[to_row, np.arange(len(to_row)) - start[to_row]] = symbols[to_row, from_col]
            symbols = close
        return out, out_lengths

    def _learn(self, pieces: list[str]) -> None:
        """Merge distinct new pieces, each by itself, in matrices of rows of like length."""
        data = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        whole = np.fromiter((self.ranks.get(d, -1) for d in data), np.int64, len(data))
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        sizes = np.where(whole >= 0, 1, 0)
        rows = np.flatnonzero(whole < 0)
        rows = rows[np.argsort(lengths[rows], kind="stable")]
        done, at = [], 0
        while at < len(rows):
            low = int(lengths[rows[at]])
            top = low + max(2, low // 4)
            end = at + int(np.searchsorted(lengths[rows[at:]], top, "right"))
            end = min(end, at + max(1, _ROWS // top))
            some = rows[at:end]
            symbols = np.full((len(some), int(lengths[some[-1]])), -1, np.int32)
            symbols[np.arange(symbols.shape[1])[None, :] < lengths[some][:, None]] = self.single[
                np.frombuffer(b"".join([data[i] for i in some]), np.uint8)
            ]
            merged, sizes[some] = self._merge(symbols, lengths[some])
            done.append((some, merged))
            at = end
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        for some, merged in done:
            r, c = np.nonzero(np.arange(merged.shape[1])[None, :] < sizes[some][:, None])
            flat[starts[some][r] + c] = merged[r, c]
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, flat))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_all(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids in one row, and where each text's begin and the last one's end.

        Every distinct piece is merged once and remembered; a full memory starts anew.
        """
        split = [self.split(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self._forget()
        fresh = set().union(*split).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        number = self.known.__getitem__
        which = np.fromiter((n for pieces in split for n in map(number, pieces)), np.int64)
        sizes = self.sizes[which]
        upto = flat_offsets(sizes)
        flat = self.ids[np.repeat(self.starts[which] - upto[:-1], sizes) + np.arange(upto[-1])]
        return flat, upto[flat_offsets(np.fromiter(map(len, split), np.int64, len(split)))]

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@cache
def loaded(path: str, pattern: str) -> BytePairs:
    """One copy of a vocabulary for each worker process."""
    return BytePairs(path, pattern)


def _mapped(
    docs: DataFrame, column: str, kept: list[str], made: str, step: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """``docs[kept]`` and the columns ``step`` makes of ``column``, in small batches, so that a
    task holds the ids of a few hundred rows beside its input."""
    names = [name.split()[0] for name in made.split(", ")]
    slots = [f"__k{i}" for i in range(len(kept))]
    rows = docs.select(F.col(column).alias("__in"), *[F.col(c).alias(s) for c, s in zip(kept, slots, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                part = batch.slice(at, _TEXTS)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *step(part.column(0))], [*slots, *names])

    schema = StructType([*rows.schema.fields[1:], *StructType.fromDDL(made).fields])
    return rows.mapInArrow(run, schema).toDF(*kept, *names)


def _as_utf8(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn(text, utf8(F.col(text)))


def _encode(pairs: BytePairs, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pairs.encode_all(str(v, "utf-8", "replace") for v in byte_views(texts))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", kept: list[str] | None = None) -> DataFrame:
    """``kept`` columns (default: all but the text) and ``ids`` (array of int) of whole texts.

    Each match of ``pattern`` is merged by itself. The ids are those of the rank file at ``path``,
    which every machine must have, without special tokens; a piece that is a token is that token.
    Null and empty texts have no ids. Bytes that are no UTF-8 become U+FFFD. A very long piece
    costs a round for each stretch of equal merges, not one a symbol. Repeated rows are each
    encoded; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != text] if kept is None else kept

    def step(texts: pa.Array) -> list[pa.Array]:
        flat, ends = _encode(loaded(path, pattern), texts)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

    return _mapped(_as_utf8(docs.select(*{text: None, **dict.fromkeys(kept)}), text), text, kept, "ids array<int>", step)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", kept: list[str] | None = None) -> DataFrame:
    """``kept`` columns (default: all but the ids) and ``decoded``, the bytes the ids stand for.

    Null or no ids give none; a null id, or one outside the vocabulary, is an error.
    """
    kept = [c for c in rows.columns if c != ids] if kept is None else kept

    def step(lists: pa.Array) -> list[pa.Array]:
        pairs = loaded(path, pattern)
        return [pa.array([pairs.decode(row or ()) for row in lists.to_pylist()], pa.binary())]

    return _mapped(rows, ids, kept, "decoded binary", step)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", kept: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``kept`` columns, ``ids`` and ``decoded``."""
    kept = [c for c in docs.columns if c != text] if kept is None else kept

    def step(texts: pa.Array) -> list[pa.Array]:
        pairs = loaded(path, pattern)
        flat, ends = _encode(pairs, texts)
        back = [pairs.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(back, pa.binary())]

    made = "ids array<int>, decoded binary"
    return _mapped(_as_utf8(docs.select(*{text: None, **dict.fromkeys(kept)}), text), text, kept, made, step)
