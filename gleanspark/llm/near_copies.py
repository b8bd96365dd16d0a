"""Near-copies of documents: equal shingle sets and SimHash groups from the vantage-point tree first,
beside them groups by minimum hashes; links are checked by the sets. Then every pair of sets at the
similarity that these groups leave apart, by an exact prefix filter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.components import components
from gleanspark.llm.shared import byte_views, stored, utf8
from gleanspark.llm.simhash import SEED, fingerprint, grouped

SHINGLE = 5  # words
SIMILARITY = 0.8  # of the sets of shingles
SAMPLE_BYTES = 64 << 20  # text from which common shingles are learned; it sets the order of shingles, not the result
COMMON = 1 << 18  # shingles ordered by their count in the sample; all others come before them
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be sent to all tasks
BANDS = 4  # pairs of minimum hashes by which more groups are found to begin with; the rest is exact without them
SKETCH_BITS = 1024
BLOCK_ROWS = 1024  # texts of one shingle that meet in one task, from either side
PAIRS_HELD = 1 << 17  # pairs of a cell looked at together
TASK_ROWS = 16_384  # rows of cells dealt to one group, on average


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The set of a text's word shingles as sorted hashes; a text of fewer words is one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(
        np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    )


def _set_id(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), SEED)


def prefix(found: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first in one order of all shingles, rare ones first: so many
    that two sets at the similarity share one of them."""
    if not len(found):
        return found
    weight = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        weight = np.where(common[at] == found, ranks[at], 0)
    least = math.ceil(SIMILARITY * len(found) - 1e-6)  # shared by any set at the similarity
    return found[np.argsort(weight, kind="stable")[: len(found) - least + 1]]


def sketch(found: np.ndarray) -> bytes:
    """Bits that tell whether a set has an odd number of hashes in each of as many bins. A shingle
    that only one of two sets has flips one bit, so they differ in at most as many bits as in shingles."""
    odd = np.bincount((found % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


_MIX = np.array([xxhash.xxh64_intdigest(str(i), SEED) | 1 for i in range(2 * BANDS)], np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """One key for every two minimum hashes of a set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.array([found[np.argmin(found * m)] for m in _MIX], np.uint64).reshape(BANDS, 2)
    return np.array(
        [xxhash.xxh3_64_intdigest(pair.tobytes(), i) for i, pair in enumerate(least)], np.uint64
    ).view(np.int64)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are common in a sample of the texts, and their ranks from 1 on."""
    total = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, math.ceil(total / SAMPLE_BYTES))
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(parts)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [shingles(bytes(v)) for v in byte_views(batch.column(0))]
            keys, counts = np.unique(np.concatenate(flat or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "texts"])

    counted = some.select("body").mapInArrow(run, "key long, texts long").groupBy("key").agg(F.sum("texts").alias("texts"))
    top = counted.where("texts > 1").orderBy(F.desc("texts"), "key").limit(COMMON).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.arange(len(keys), 0, -1)[order]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _printed(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, set_id, n, keys, bands, bits``: SimHash of every text, its shingle set by
    its hash, size, prefix, minimum hashes and sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, ranks = sent.value
        for batch in batches:
            views = byte_views(batch.column(1))
            prints = np.array([fingerprint(v) for v in views], np.uint64).view(np.int64)
            sets = [shingles(bytes(v)) for v in views]
            ids = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(prints),
                    pa.array(ids),
                    pa.array([len(s) for s in sets], pa.int32()),
                    _lists([prefix(s, common, ranks).view(np.int64) for s in sets]),
                    _lists([bands(s) for s in sets]),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "fingerprint", "set_id", "n", "keys", "bands", "bits"],
            )

    return docs.mapInArrow(
        run, "doc_id long, fingerprint long, set_id long, n int, keys array<long>, bands array<long>, bits binary"
    )


def _grouped(printed: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: each set with the smallest one of its SimHash groups, found through the vantage-point
    tree, and with the smallest one of the same two minimum hashes, for every band."""
    prints = printed.select("set_id", "fingerprint").distinct()
    near = prints.join(grouped(printed), "fingerprint").select(
        "set_id", F.xxhash64(F.lit("simhash"), "component_id").alias("key")
    )
    laid = near.distinct().union(classes.select("set_id", F.explode("bands").alias("key")))
    least = laid.groupBy("key").agg(F.min("set_id").alias("b"), F.count("*").alias("texts")).where("texts > 1")
    return laid.join(least, "key").where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()


def _met(classes: DataFrame, known: DataFrame) -> DataFrame:
    """``key, set_id, root, n, at, prior, texts, bits``: prefix shingles that sets of several groups share.

    ``known`` names the groups found so far; no pair within one is looked for any more. ``prior``
    is the set's shared shingle before this one, or this one itself if there is none.
    """
    root = F.coalesce("root", "set_id").alias("root")
    laid = classes.join(known, "set_id", "left").select("set_id", root, "n", F.posexplode("keys").alias("at", "key"))
    counts = [F.count("*").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high")]
    shared = stored(laid.groupBy("key").agg(*counts).where("low < high").select("key", "texts"), "keys-met")
    before = F.lag("key").over(Window.partitionBy("set_id").orderBy("at"))
    met = laid.join(shared, "key").withColumn("prior", F.coalesce(before, F.col("key")))
    return stored(met.join(classes.select("set_id", "bits"), "set_id"), "shingles-met")


def _still_apart(met: DataFrame, known: DataFrame) -> DataFrame:
    """``met`` under the groups of ``known``, without shingles that only one group has by now."""
    rows = met.drop("root", "texts").join(known, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    counts = [F.count("*").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high")]
    shared = rows.groupBy("key").agg(*counts).where("low < high").select("key", "texts")
    return stored(rows.join(shared, "key"), "shingles-apart")


class _Cell:
    """The columns of one cell's rows as arrays."""

    def __init__(self, rows: dict, at: np.ndarray):
        self.ids, self.root, self.prior = rows["set_id"][at], rows["root"][at], rows["prior"][at]
        self.n, self.at, self.bits = rows["n"][at], rows["at"][at], rows["bits"][at]
        self.repeat = self.prior != rows["key"][at[0]]
        self.own, self.other = np.flatnonzero(rows["own"][at]), np.flatnonzero(rows["other"][at])

    def possible(self, some: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be at the similarity, and the bits in which they differ.

        They may by their groups, by their sizes, by what is left of both sets after the shared
        shingle, and by the shingles that the bits prove to be in one set alone, at most a ninth
        of both sizes at 0.8. A pair that has met at the shingle before is passed by. No pair of
        two groups at the similarity is refused.
        """
        may = self.root[some][:, None] != self.root[other][None, :]
        far = np.full(may.shape, np.iinfo(np.int16).max, np.int16)
        both = self.n[some][:, None] + self.n[other][None, :]
        shared = np.minimum((self.n - self.at)[some][:, None], (self.n - self.at)[other][None, :])
        # room for rounding, which never refuses a pair that may be similar
        may &= shared + np.float32(0.01) >= np.float32(SIMILARITY / (1 + SIMILARITY) * 0.99999) * both
        may &= (self.prior[some][:, None] != self.prior[other][None, :]) | ~self.repeat[some][:, None]
        a, b = np.nonzero(may)
        found = np.zeros(len(a), np.int16)
        for lo in range(0, len(a), PAIRS_HELD // 8):
            part = slice(lo, lo + PAIRS_HELD // 8)
            found[part] = np.bitwise_count(self.bits[some[a[part]]] ^ self.bits[other[b[part]]]).sum(axis=1)
        bound = np.float32((1 - SIMILARITY) / (1 + SIMILARITY) * 1.00001) * both[a, b] + np.float32(0.01)
        may[a, b] = found <= bound
        far[a, b] = found
        return may, far

    def parts(self) -> list[np.ndarray]:
        return np.array_split(self.own, max(1, len(self.own) * len(self.other) // PAIRS_HELD))


def _picked(cell: _Cell) -> Iterator[np.ndarray]:
    """For each set the first and the nearest possible other by sketch, with the distance."""
    for some in cell.parts():
        may, far = cell.possible(some, cell.other)
        far[~may] = np.iinfo(np.int16).max
        for pick in (np.argmax(may, axis=1), np.argmin(far, axis=1)):
            here = may[np.arange(len(some)), pick]
            near = far[np.arange(len(some)), pick]
            yield np.stack((cell.ids[some], cell.ids[cell.other][pick], near), axis=1)[here]


def _parted(cell: _Cell) -> Iterator[np.ndarray]:
    """All possible pairs of two groups."""
    for some in cell.parts():
        a, b = np.nonzero(cell.possible(some, cell.other)[0])
        yield np.stack((cell.ids[some][a], cell.ids[cell.other][b], np.zeros(len(a), np.int64)), axis=1)


def _in_cells(met: DataFrame, pairs_of) -> DataFrame:
    """``a, b, far`` by ``pairs_of`` among the sets of each shingle.

    The rows of one shingle are dealt as cells of two blocks by counted sizes; cells are dealt to
    as many groups as their counted rows ask for.
    """
    blocks = F.ceil(F.col("texts") / F.lit(BLOCK_ROWS)).cast("int")
    rows = met.agg(F.sum(F.lit(2) * blocks - 1)).first()[0] or 0
    cells = (
        met.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks", "texts")
    )
    # in cell (i, j) block i looks for its partners in block j
    both = cells.withColumns(
        {"i": F.col("block"), "j": F.col("with"), "own": F.lit(True), "other": F.col("block") == F.col("with")}
    ).union(
        cells.where("block <> with").withColumns(
            {"i": F.col("with"), "j": F.col("block"), "own": F.lit(False), "other": F.lit(True)}
        )
    )
    tasks = rows // TASK_ROWS + 1

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = {c: part[c].to_numpy() for c in ("key", "i", "j", "set_id", "root", "prior", "own", "other")}
        rows |= {c: part[c].to_numpy().astype(np.float32) for c in ("n", "at")}
        rows["bits"] = np.frombuffer(b"".join(part["bits"]), np.uint64).reshape(len(part), -1)
        order = np.lexsort((rows["j"], rows["i"], rows["key"]))
        cell = np.stack([rows[c][order] for c in ("key", "i", "j")])
        starts = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0))))
        found = [np.zeros((0, 3), np.int64)]
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            if hi - lo > 1:
                found += pairs_of(_Cell(rows, order[lo:hi]))
        flat = np.concatenate(found)
        return pd.DataFrame({"a": flat[:, 0], "b": flat[:, 1], "far": flat[:, 2]}).drop_duplicates()

    dealt = both.drop("block", "with").withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(run, "a long, b long, far long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are as similar as asked, by the texts themselves."""
    some = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    ends = stored(classes.join(some, "set_id", "left_semi").select(F.col("first").alias("doc_id")).distinct(), "near-ends")
    if ends.count() <= BROADCAST_IDS:
        ends = F.broadcast(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(bytes(t)) for t in byte_views(batch.column(0))]
            ids = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
            held = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), held], ["set_id", "set"])

    laid = docs.join(ends, "doc_id", "left_semi").select("body").mapInArrow(run, "set_id long, set array<long>")
    held = stored(laid.groupBy("set_id").agg(F.first("set").alias("set")), "shingles")
    both = pairs.join(held.select(F.col("set_id").alias("a"), F.col("set").alias("sa")), "a").join(
        held.select(F.col("set_id").alias("b"), F.col("set").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(SIMILARITY) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _groups(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("set_id"), F.col("component").alias("root"))


def _links(printed: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b``: links of sets at the similarity, whose components are those of all such links.

    Sets are compared with the first one of their SimHash group and of equal minimum hashes to begin
    with, which brings most copies into groups; a SimHash link alone is none. Two sets at the similarity share a shingle of their prefixes, so what is
    left is among prefix shingles of several groups: first each set's first and nearest partner
    by sketch of another group, then every possible pair of two groups. No link is left out.
    """
    first = stored(_verified(stored(_grouped(printed, classes), "near-grouped"), classes, docs), "links-grouped")
    met = _met(classes, _groups(first))
    picked = _in_cells(met, _picked).groupBy("a").agg(F.min("b").alias("first"), F.min_by("b", "far").alias("near"))
    pairs = picked.select("a", F.explode(F.array("first", "near")).alias("b"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    near = stored(_verified(stored(pairs, "near-picked"), classes, docs), "links-picked").union(first)
    apart = _still_apart(met, _groups(near))
    rest = stored(_in_cells(apart, _parted).where("a > b").select("a", "b").distinct(), "near-apart")
    return near.union(_verified(rest, classes, docs))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group of near-copies left.

    Groups are the components of the links between all texts whose sets of five-word shingles
    have a similarity of 0.8 or more, found exactly but for equal hashes. The smallest doc_id of
    a group stays. Texts without words are copies of each other. Rows without a doc_id can't be
    told apart by it and stay as they are. Repeated rows of one doc_id stay or go together. An
    empty table stays empty.
    """
    texts = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("body")
    )
    printed = stored(_printed(texts), "shingles-first")
    # texts of one set are one, named by the smallest doc_id
    one = [F.first(c).alias(c) for c in ("n", "keys", "bands", "bits")]
    classes = stored(printed.groupBy("set_id").agg(F.min("doc_id").alias("first"), *one), "sets")
    first = classes.select("set_id", "first")
    links = _links(printed, classes, texts)
    of_docs = (
        links.join(first.select(F.col("set_id").alias("a"), F.col("first").alias("fa")), "a")
        .join(first.select(F.col("set_id").alias("b"), F.col("first").alias("fb")), "b")
        .select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    )
    # a doc_id repeated with other words brings the groups of its texts together
    repeated = printed.groupBy("doc_id").agg(F.min("set_id").alias("l"), F.max("set_id").alias("h")).where("l <> h")
    same = printed.join(repeated.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_id").join(first, "set_id")
    edges = of_docs.union(same.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    later = components(edges).where("node <> component").select(F.col("node").alias("doc_id"))
    stay = first.select(F.col("first").alias("doc_id")).distinct().join(later, "doc_id", "left_anti")
    stay = stay.withColumnRenamed("doc_id", "__stays")
    return docs.where("doc_id IS NULL").union(docs.join(stay, docs["doc_id"] == F.col("__stays"), "left_semi"))
