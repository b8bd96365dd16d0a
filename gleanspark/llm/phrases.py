"""Collocations: phrases by recursive pair counts over frequency-ranked ids, in dense and sparse tiles."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.shared import byte_views, shared_folder, stored, utf8

LEAST = 100  # occurrences of a phrase
LONGEST = 5  # words
CHUNK_BYTES = 8 << 20  # text whose ids are held together
SENT_BYTES = 64 << 20  # ids that may be sent to all tasks
TILE = 1024  # ranks on either side of a tile
DENSE = 8  # a tile is dense if one in so many of its places is filled on average
_SPREAD = 16  # groups that the pairs of one first symbol are dealt to
_ROW_SALT = 20_000  # candidates of a language ranked in one task

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and the text as their numbers: -1 between two pieces."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    within = kind == 0
    edges = np.flatnonzero(np.diff(within, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    flat = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[within]])]
    ).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    breaks = np.flatnonzero(np.diff(piece)) + 1
    return flat.dictionary, np.bincount(codes, minlength=len(flat.dictionary)), np.insert(codes, breaks, -1)


def tiled(x: np.ndarray, y: np.ndarray, size: int, tile: int = TILE) -> tuple[np.ndarray, ...]:
    """Distinct pairs of ranks below ``size``, their counts, and the pair at each place.

    The pairs are split into tiles of ranks. A well-filled tile is a direct-address table counted
    by bincount; the pairs of all others are sorted as coordinates.
    """
    side = -(-size // tile)
    x, y = x.astype(np.int64), y.astype(np.int64)
    at = (x // tile) * side + y // tile
    names, load = np.unique(at, return_counts=True)
    inverse, left, right, counts = np.empty(len(x), np.int64), [], [], []
    made, sparse = 0, np.ones(len(x), bool)
    for name in names[load >= max(1, tile * tile // DENSE)].tolist():
        here = np.flatnonzero(at == name)
        sparse[here] = False
        cell = (x[here] % tile) * tile + y[here] % tile
        table = np.bincount(cell, minlength=tile * tile)
        filled = np.flatnonzero(table)
        number = np.zeros(tile * tile, np.int64)
        number[filled] = np.arange(made, made + len(filled))
        inverse[here] = number[cell]
        left.append(name // side * tile + filled // tile)
        right.append(name % side * tile + filled % tile)
        counts.append(table[filled])
        made += len(filled)
    keys, place, found = np.unique(x[sparse] * size + y[sparse], return_inverse=True, return_counts=True)
    inverse[sparse] = made + place
    left, right, counts = [*left, keys // max(size, 1)], [*right, keys % max(size, 1)], [*counts, found]
    return np.concatenate(left), np.concatenate(right), np.concatenate(counts), inverse


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype(np.int32).tobytes(), "zstd", asbytes=True)


def _unpacked(data, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * 4, "zstd"), np.int32)


@dataclass(frozen=True)
class Chunks:
    """Files of chunks in the shared folder: symbols as rows, in ``texts`` the packed text, a chunk a row group of both.

    A chunk's number is the partition that wrote it, times 2^32, and its row group. ``parts`` names a
    partition's file, of the attempt that ended well, with its number of chunks.
    """

    folder: str
    schema: str
    parts: dict[int, tuple[str, int]]

    def symbols(self, spark: SparkSession) -> DataFrame:
        paths = [f"{self.folder}/symbols/{name}" for name, _ in self.parts.values()]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, part: int, columns: list[str], groups: list[int] | None = None) -> Iterator[tuple[pa.Table | None, np.ndarray]]:
        """``columns`` of the symbols, if any, and the text of a partition's chunks, one at a time."""
        store, root = fs.FileSystem.from_uri(self.folder)
        name, made = self.parts[part]
        with contextlib.ExitStack() as held:
            texts, symbols = (
                pq.ParquetFile(held.enter_context(store.open_input_file(f"{root}/{kind}/{name}"))) if kind == "texts" or columns else None
                for kind in ("texts", "symbols")
            )
            for k in range(made) if groups is None else groups:
                text = texts.read_row_group(k)
                seq = _unpacked(text.column("seq")[0].as_buffer(), text.column("size")[0].as_py())
                yield symbols.read_row_group(k, columns) if columns else None, seq


def _kept(frame: DataFrame, run: Callable, kinds: dict[str, pa.DataType], encoded: dict[str, str], schema: str, name: str) -> Chunks:
    """What ``run`` makes of a task's batches: arrays of a chunk's symbols, of ``kinds``, and its text as numbers.

    Workers write it themselves, chunk by chunk. A chunk is never a row of Spark's, which its JVM would
    hold several times, and no process is started for the permissions of each file. ``encoded`` are
    columns, and how, of which a dictionary would be as long as they are."""
    folder = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    columns = pa.schema({"chunk": pa.int64(), **kinds})
    repeated = [k for k in ("chunk", "lang", "count", "bucket", "n.list.element") if k.split(".")[0] in columns.names]
    texts = pa.schema({"size": pa.int64(), "seq": pa.binary()})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        file = f"part-{part:05d}-{uuid.uuid4().hex}.parquet"
        with contextlib.ExitStack() as held:

            def opened(kind: str, schema: pa.Schema, **how) -> pq.ParquetWriter:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(f"{root}/{kind}")
                return held.enter_context(
                    pq.ParquetWriter(held.enter_context(store.open_output_stream(f"{root}/{kind}/{file}")), schema, **how)
                )

            for arrays, seq in run(batches):
                if not made:
                    symbols = opened("symbols", columns, compression="zstd", compression_level=3, use_dictionary=repeated, column_encoding=encoded)
                    packed = opened("texts", texts, compression="none", use_dictionary=False, write_statistics=False)
                rows = len(arrays[0])
                number = pa.array(np.full(rows, (part << 32) + made, np.int64))
                symbols.write_table(pa.Table.from_arrays([number, *arrays], schema=columns), row_group_size=rows)
                text = [pa.array([len(seq)], pa.int64()), pa.array([_packed(seq)], pa.binary())]
                packed.write_table(pa.Table.from_arrays(text, schema=texts))
                made += 1
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([file]), pa.array([made])], ["part", "file", "made"])

    files = frame.mapInArrow(write, "part long, file string, made long").collect()  # a row for each partition
    return Chunks(folder, schema, {r.part: (r.file, r.made) for r in files})


def _word_chunks(docs: DataFrame, chunk_bytes: int) -> Chunks:
    """``chunk, lang, at, word, count``: the words of chunks of a language's texts, which are numbers ``at``."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8(F.col("text")).alias("body"))
    kinds = {"lang": pa.string(), "at": pa.int32(), "word": pa.binary(), "count": pa.int64()}

    def handed(held: dict[str, list[bytes]]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        for lang in list(held):
            words, counts, seq = words_of(b"\n".join(held.pop(lang)))
            if len(words):
                at = pa.array(np.arange(len(words), dtype=np.int32))
                yield [pa.repeat(lang, len(words)), at, words, pa.array(counts.astype(np.int64))], seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), byte_views(batch.column(1)), strict=True):
                held.setdefault(lang, []).append(bytes(body))
                size += len(body)
                if size >= chunk_bytes:
                    yield from handed(held)
                    held, size = {}, 0
        yield from handed(held)

    schema = "chunk long, lang string, at int, word binary, count long"
    encoded = {"at": "DELTA_BINARY_PACKED", "word": "DELTA_LENGTH_BYTE_ARRAY"}
    return _kept(texts, run, kinds, encoded, schema, "word-chunks")


def _looked_up(ranked: DataFrame, width: int) -> tuple[list[str], Callable, object]:
    """Columns of a chunk's symbols, how to find there their numbers and ids, and what is sent to the tasks for it: all ids.

    ``width`` is the number of symbols that pairs are made of, 0 where the symbols are words.
    """
    context = ranked.sparkSession.sparkContext
    if not width:
        rows = ranked.select("lang", "word", "id").toArrow()
        by_lang = {}
        for lang in rows.column("lang").unique().to_pylist():
            of = rows.filter(pc.equal(rows.column("lang"), lang))
            by_lang[lang] = (of.column("word").combine_chunks(), of.column("id").to_numpy())
        sent = context.broadcast(by_lang)

        def words_in(symbols: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            known, ids = sent.value.get(symbols.column("lang")[0].as_py(), (pa.array([], pa.binary()), np.zeros(0, np.int64)))
            # all frequent words are looked up among the chunk's, so the hash table is of the chunk's
            place = pc.index_in(known, value_set=symbols.column("word").combine_chunks()).fill_null(-1).to_numpy()
            return place[place >= 0], ids[place >= 0]

        return ["lang", "word"], words_in, sent
    rows = ranked.select("a", "b", "id").toArrow()
    keys = rows.column("a").to_numpy() * width + rows.column("b").to_numpy()
    order = np.argsort(keys)
    sent = context.broadcast((keys[order], rows.column("id").to_numpy()[order]))

    def pairs_in(symbols: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, ids = sent.value
        a, b = (symbols.column(k).combine_chunks().flatten().to_numpy().astype(np.int64) for k in ("a", "b"))
        asked = a * width + b
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        there = np.flatnonzero(keys[place] == asked)
        return there, ids[place[there]]

    return ["a", "b"], pairs_in, sent


def _brought(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each chunk with its symbols' numbers and ids, from rows ``chunk, at, id`` in the order of ``chunk``."""
    chunk, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in range(3)]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(columns[0])) + 1, [len(batch)]))
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            if columns[0][start] != chunk:
                if held:
                    yield chunk, *map(np.concatenate, zip(*held, strict=True))
                chunk, held = int(columns[0][start]), []
            held.append((columns[1][start:end].copy(), columns[2][start:end].copy()))
    if held:
        yield chunk, *map(np.concatenate, zip(*held, strict=True))


def _grouped(a: np.ndarray, b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings the pairs of one group together, sorted, and where the groups end. The group
    of a pair is a hash of its ids, the same in every chunk, and shared by one in ``_SPREAD`` of the pairs
    of its first symbol, so equal ids lie together and compress."""
    some = (b % _SPREAD).astype(np.uint64)
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + some * np.uint64(0xC2B2AE3D27D4EB4F)
    group = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(groups)
    return np.lexsort((b, a, group)), np.cumsum(np.bincount(group.astype(np.int64), minlength=groups))


def _paired(chunks: Chunks, ids: DataFrame, find: Callable, last: bool, tile: int, groups: int, kind: str) -> Chunks:
    """``chunk, bucket, start, a, b, n``: adjacent pairs of chunks' frequent symbols by their ids, as groups
    by hash, ``start`` being the number of a group's first pair.

    ``find`` gives from batches of ``ids`` numbers and ids of a chunk's frequent symbols, and its text.
    ``last`` leaves the text out; ``kind`` is the type of ids."""
    numbers = np.int32 if kind == "int" else np.int64

    def of_groups(a: np.ndarray, b: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        full = np.flatnonzero(np.diff(ends, prepend=0))
        starts = np.concatenate(([0], ends[:-1]))[full]
        cut = pa.array(np.append(starts, len(a)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (a.astype(numbers), b.astype(numbers), counts.astype(np.int32))]
        return [pa.array(full.astype(np.int32)), pa.array(starts.astype(np.int64)), *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        for symbols, ids, text in find(batches):
            if not len(symbols):
                continue
            # the chunk's symbols by their rank in the whole corpus
            order = np.argsort(ids)
            ranked = np.full(int(symbols.max()) + 1, -1, np.int32)
            ranked[symbols[order]] = np.arange(len(ids), dtype=np.int32)
            ids = ids[order]
            text = np.where((text >= 0) & (text < len(ranked)), ranked[np.minimum(text, len(ranked) - 1)], -1)
            both = (text[:-1] >= 0) & (text[1:] >= 0)
            if not both.any():
                continue
            left, right, counts, inverse = tiled(text[:-1][both], text[1:][both], len(ids), tile)
            order, ends = _grouped(ids[left], ids[right], groups)
            pairs = np.full(0 if last else len(both), -1, np.int32)
            if not last:
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                pairs[both] = place[inverse]
                pairs = pairs[(pairs >= 0) | (np.concatenate(([-1], pairs[:-1])) >= 0)]  # one -1 between stretches
            yield of_groups(ids[left][order], ids[right][order], counts[order], ends), pairs

    element = pa.int32() if kind == "int" else pa.int64()
    kinds = {"bucket": pa.int32(), "start": pa.int64(), "a": pa.list_(element), "b": pa.list_(element), "n": pa.list_(pa.int32())}
    schema = f"chunk long, bucket int, start long, a array<{kind}>, b array<{kind}>, n array<int>"
    encoded = dict.fromkeys(["start", "a.list.element"], "DELTA_BINARY_PACKED")
    return _kept(ids, run, kinds, encoded, schema, "pair-chunks")


def _ranked(counted: DataFrame, by: list[str], least: int) -> DataFrame:
    """``by, f`` of symbols that occur ``least`` times, with ``id``, the rank by ``f``, the most frequent first, gapless from 0.

    These are few rows of many tasks, so they are brought together before they are written."""
    spark = counted.sparkSession
    order = [F.desc("f"), *by]
    frequent = stored(counted.where(F.col("f") >= least).select(*by, "f").hint("rebalance"), "frequent")
    laid = frequent.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stored(
        laid.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
        "by-frequency",
    )
    sizes, before, rows = dict(laid.groupBy("part").count().collect()), 0, []  # a row for each partition
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    starts = spark.createDataFrame(rows, "part int, before long")
    return laid.join(F.broadcast(starts), "part").withColumn("id", F.col("before") + F.col("at")).drop("part", "before", "at")


def _by_all_ids(chunks: Chunks, ranked: DataFrame, width: int) -> tuple[DataFrame, Callable, object]:
    """Partitions of the chunks, and how to find ids there by all ids sent to the tasks, which comes third."""
    columns, find, sent = _looked_up(ranked, width)
    parts = sorted(chunks.parts)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for symbols, text in chunks.read(parts[k], columns):
                    yield *find(symbols), text

    return ranked.sparkSession.range(0, len(parts), 1, max(1, len(parts))), found, sent


def _by_own_ids(chunks: Chunks, symbols: DataFrame, ranked: DataFrame, by: list[str]) -> tuple[DataFrame, Callable]:
    """Rows that bring each chunk the ids of those of its symbols that are frequent, and how to read them."""
    known = symbols.join(ranked.select(*by, "id"), by).select("chunk", F.col("at").cast("long").alias("at"), "id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for chunk, symbols, ids in _brought(batches):
            for _, text in chunks.read(chunk >> 32, [], [chunk & 0xFFFFFFFF]):
                yield symbols, ids, text

    return known.repartition("chunk").sortWithinPartitions("chunk"), found


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3])


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = 2000,
    chunk_bytes: int = CHUNK_BYTES,
    tile: int = TILE,
    sent: int = SENT_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to five words of a language.

    Texts are lower-cased (A to Z), cut into pieces at ``. , ; : ! ?`` and line ends, and these into
    words at blanks. A phrase that occurs ``a >= least`` times within pieces is a candidate. Cut
    in two it has ``floor(1000 a n / (l r))``, its parts occurring l and r times among n words; its
    score is that of the lowest cut, the first of equal ones. A candidate inside a longer one that
    occurs as often is left out. Order: score, a, phrase.

    Words get ids by their frequency in the corpus. Adjacent ids are pairs, split into tiles of
    ranks: well-filled tiles are counted by bincount in a direct-address table, the others as
    sorted coordinates. Counts of chunks are summed by pair; pairs frequent enough get ids by
    frequency and are paired again with the next one, which overlaps them in all but one word.
    The ids are sent to all tasks where they are counted to take at most ``sent`` bytes; beyond
    that a join brings each chunk the ids of its own symbols. The longest document sets the largest chunk.

    Null text is empty; a null language is ``und``; repeated rows count each; an empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    chunks = _word_chunks(docs, chunk_bytes)
    symbols = chunks.symbols(spark)
    totals = symbols.groupBy("lang").agg(F.sum("count").alias("n"))
    counted = symbols.groupBy("lang", "word").agg(F.sum("count").alias("f"))
    by, tables, width = ["lang", "word"], [], 0
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for length in range(1, LONGEST + 1):
        ranked = _ranked(counted, by, least)
        if length == 1:
            tables.append(
                ranked.select(
                    "id", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("end"), "f",
                    F.array().cast("array<long>").alias("firsts"), F.array().cast("array<long>").alias("lasts"),
                )
            )
        else:
            head = tables[-1].select(
                F.col("id").alias("a"), "lang", F.col("phrase").alias("start"), F.array_append("firsts", F.col("f")).alias("firsts")
            )
            tail = tables[-1].select(F.col("id").alias("b"), "end", F.array_append("lasts", F.col("f")).alias("lasts"))
            grown = ranked.join(head, "a").join(tail, "b").withColumn("phrase", F.concat_ws(" ", "start", "end"))
            tables.append(stored(grown.drop("start"), "phrases"))
        word_bytes = F.octet_length("word") if length == 1 else F.lit(0)
        rows, size = ranked.agg(F.count("*"), F.sum(word_bytes + 24)).first()  # a word or a pair, and an id
        if not rows or length == LONGEST:
            break
        kind, last, shared = "int" if rows < 1 << 31 else "long", length + 1 == LONGEST, None
        if size <= sent:
            ids, find, shared = _by_all_ids(chunks, ranked, width)
        else:
            ids, find = _by_own_ids(chunks, symbols, ranked, by)
        chunks, width = _paired(chunks, ids, find, last, tile, groups, kind), rows
        if shared is not None:
            shared.destroy()
        parts = chunks.symbols(spark)
        symbols = parts.select("chunk", "start", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x")).select(
            "chunk", (F.col("start") + F.col("at")).alias("at"), *[F.col(f"x.{c}").cast("long").alias(c) for c in ("a", "b")]
        )
        # a pair's counts of all chunks meet in its group; whole groups are moved, not single pairs
        dealt = parts.select("bucket", "a", "b", "n").repartition("bucket")
        laid = dealt.select("bucket", F.explode(F.arrays_zip("a", "b", "n")).alias("x"))
        counted = laid.groupBy("bucket", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("x.n").alias("f"))
        counted = counted.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "f")
        by = ["a", "b"]
    kept = None
    for length, table in enumerate(tables[1:], 2):
        rows = table
        if length < len(tables):
            longer = tables[length].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("longer"))
            longer = longer.groupBy("id").agg(F.max("longer").alias("longer"))
            rows = rows.join(longer, "id", "left").where(F.coalesce(F.col("longer") < F.col("f"), F.lit(True)))
        cuts = [
            F.struct(
                _score(F.col("f"), F.col("n"), F.get("firsts", F.lit(k - 1)), F.get("lasts", F.lit(length - k - 1))).alias("score"),
                F.lit(k).alias("k"),
                F.get("firsts", F.lit(k - 1)).alias("l"),
                F.get("lasts", F.lit(length - k - 1)).alias("r"),
            )
            for k in range(1, length)
        ]
        rows = rows.join(totals, "lang").withColumn("cut", F.array_min(F.array(*cuts)))
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        kept = rows if kept is None else kept.union(rows)
    if kept is None:
        schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], schema)
    kept = stored(kept, "candidates")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salts = math.ceil(kept.count() / _ROW_SALT) or 1
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return first.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
