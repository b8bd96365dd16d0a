"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.components import Forest, components
from gleanspark.llm.shared import stored

TABLES = 8
PROBES = 6
BUCKET_ROWS = 96  # vectors a bucket should hold on average
BLOCK_ROWS = 2048  # of a larger bucket, so many meet in one task
_CHOICES = 4  # best vertices of one polytope that probes combine


@dataclass(frozen=True)
class Hashing:
    """What all tasks share: seeds and shape, no data. ``parts`` are the coordinates each of a
    table's polytopes keeps, so a table has the product of twice these as buckets."""

    dims: int
    parts: tuple[int, ...]
    tables: int = TABLES
    probes: int = PROBES
    seed: int = 17


def shape_for(dims: int, rows: int, bucket_rows: int = BUCKET_ROWS) -> tuple[int, ...]:
    """Polytopes for about ``rows / bucket_rows`` buckets: whole ones, then one over fewer axes."""
    width = 1 << max(0, dims - 1).bit_length()
    bits, parts = max(1, round(np.log2(max(2, rows / bucket_rows)))), []
    while bits > 0:
        take = min(bits, width.bit_length())
        parts.append(1 << (take - 1))
        bits -= take
    return tuple(parts)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


def codes(unit: np.ndarray, shape: Hashing) -> np.ndarray:
    """Buckets by row, table and probe; probe 0 is the row's own bucket, others by rising loss.

    Each polytope hash applies three rounds of random signs and the Hadamard transform and takes
    the nearest signed axis. A probe swaps in near vertices; its loss is the sum of the squared
    distances given up. Probes beyond the buckets that exist repeat the own one.
    """
    n = len(unit)
    width = 1 << max(0, shape.dims - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, : shape.dims] = unit
    out = np.zeros((n, shape.tables, shape.probes), np.int64)
    random = np.random.default_rng(shape.seed)
    for table in range(shape.tables):
        code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for axes in shape.parts:
            y = padded
            for _ in range(3):
                y = hadamard(y * random.choice((-1.0, 1.0), width))
            y = y[:, :axes]
            vertices = np.concatenate((y, -y), axis=1)
            take = min(_CHOICES, 2 * axes)
            best = np.argsort(-vertices, axis=1, kind="stable")[:, :take]
            near = np.take_along_axis(vertices, best, axis=1)
            code = (code[:, :, None] * (2 * axes) + best[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(n, -1)
            if code.shape[1] > 4 * shape.probes:
                keep = np.argsort(loss, axis=1, kind="stable")[:, : 4 * shape.probes]
                code, loss = np.take_along_axis(code, keep, axis=1), np.take_along_axis(loss, keep, axis=1)
        order = np.argsort(loss, axis=1, kind="stable")[:, : shape.probes]
        found = np.take_along_axis(code, order, axis=1)
        out[:, table, : found.shape[1]] = found
        out[:, table, found.shape[1] :] = found[:, :1]
    return out


def _sees(probes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By pair and table: is the one's own bucket among the other's probes?"""
    return (probes == own[:, :, None]).any(axis=2)


def verified(cell: pd.DataFrame, shape: Hashing, cosine: float) -> pd.DataFrame:
    """Links of one cell, each counted in the first table and direction in which it turns up.

    Dwellers have their own bucket here, visitors probe it. Returns, for each class with links
    here, how many vectors it gained and the first class of its group in this cell.
    """
    cell = cell.sort_values("cls", kind="stable")
    vectors = np.array(cell["embedding"].tolist(), np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    probes = np.array(cell["probes"].tolist(), np.int64).reshape(len(cell), shape.tables, shape.probes)
    own, cls, weight = probes[:, :, 0], cell["cls"].to_numpy(), cell["w"].to_numpy()
    table = int(cell["table"].iloc[0])
    dwell, visit = np.flatnonzero(cell["dwells"].to_numpy()), np.flatnonzero(cell["visits"].to_numpy())
    # a class that both dwells and visits here has a row for either
    names, number = np.unique(cls, return_inverse=True)
    gained, forest = np.zeros(len(names), np.int64), Forest(len(names))
    step = max(1, 2_000_000 // max(1, len(visit)))
    for at in range(0, len(dwell), step):
        rows = dwell[at : at + step]
        dots = vectors[rows] @ vectors[visit].T
        a, b = np.nonzero(dots >= cosine * (norms[rows][:, None] * norms[visit][None, :]) - 1e-9)
        a, b = rows[a], visit[b]
        keep = cls[a] != cls[b]
        a, b = a[keep], b[keep]
        for some in np.array_split(np.arange(len(a)), max(1, len(a) // 100_000)):
            x, y = a[some], b[some]
            exact = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norms[x] * norms[y]) >= cosine
            x, y = x[exact], y[exact]
            there, back = _sees(probes[y], own[x]), _sees(probes[x], own[y])
            first = ~(there | back)[:, :table].any(axis=1) & (~back[:, table] | (cls[x] < cls[y]))
            x, y = x[first], y[first]
            np.add.at(gained, number[x], weight[y])
            np.add.at(gained, number[y], weight[x])
            forest.link(number[x], number[y])
    has = gained > 0
    return pd.DataFrame({"cls": names[has], "gained": gained[has], "root": names[forest.roots()[has]]})


def embedding_links(
    classes: DataFrame,
    dims: int,
    rows: int,
    cosine: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``cls, gained, root`` per cell for distinct vectors ``cls, w, embedding`` of one length.

    Every vector dwells in one bucket a table and visits its probes; buckets follow the row
    count. A bucket above ``block_rows`` is dealt as cells of two blocks by counted sizes, so a
    dense bucket is compared whole but never in one task, and only counts and trees leave a cell.
    """
    shape = Hashing(dims, shape_for(dims, rows, bucket_rows), tables, probes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(len(batch), shape.dims)
            found = codes(x / np.linalg.norm(x, axis=1)[:, None], shape)
            flat = pa.array(found.reshape(-1))
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (shape.tables * shape.probes))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, flat)], [*batch.schema.names, "probes"]
            )

    coded = stored(
        classes.select("cls", "w", "embedding").mapInArrow(
            hashed, "cls long, w long, embedding array<float>, probes array<long>"
        ),
        "polytope",
    )
    at = coded.select(
        "cls",
        "probes",
        F.posexplode("probes").alias("slot", "bucket"),
    ).select(
        "cls",
        F.expr(f"slot div {probes}").cast("int").alias("table"),
        "bucket",
        (F.pmod("slot", F.lit(probes)) == 0).alias("own"),
    )
    # probes that repeat the own bucket are not visits of their own
    at = at.groupBy("cls", "table", "bucket").agg(F.max("own").alias("dwells"))
    sizes = at.groupBy("table", "bucket").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"),
        F.max("dwells").alias("lived"),
        F.count("*").alias("n"),
    )
    held = sizes.where("lived AND n > 1").select("table", "bucket", "blocks")
    cells = (
        at.join(held, ["table", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        # a dweller meets every block of visitors, a visitor every block of dwellers
        .withColumn("ways", F.when(F.col("dwells"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
        .withColumn("dweller", F.explode("ways"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cls",
            "table",
            "bucket",
            F.when(F.col("dweller"), F.col("block")).otherwise(F.col("other")).alias("i"),
            F.when(F.col("dweller"), F.col("other")).otherwise(F.col("block")).alias("j"),
            F.col("dweller").alias("dwells"),
            (~F.col("dweller")).alias("visits"),
        )
        .join(coded, "cls")
    )

    return cells.groupBy("table", "bucket", "i", "j").applyInPandas(
        lambda cell: verified(cell, shape, cosine), "cls long, gained long, root long"
    )


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, **tuning: int) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Needs ``vec_id`` (long) and ``embedding`` (array of float); other columns are not read.
    Vectors that are null, empty or zero, or hold null or non-finite parts, link with nothing,
    nor do rows without a vec_id (their component_id is null and they are not kept). Vectors of
    different lengths do not link. Equal vectors are one class: they are compared once and
    counted by their number. Cosines are taken in double precision and nothing below
    ``cosine`` links; pairs above it are found with the recall of the hashing (see README).
    Repeated rows of one vec_id count as one vector. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    # x - x is null for null parts and NaN for infinite ones, so the sum tells both
    fit = F.expr(
        "vec_id IS NOT NULL AND size(embedding) > 0 AND "
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND "
        "exists(embedding, x -> x <> 0)"
    )
    fine = rows.where(fit).distinct()
    classes = stored(
        fine.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("w")), "vectors"
    )
    lengths = classes.groupBy(F.size("embedding").alias("dims")).count().collect()  # one row a length
    parts = [
        embedding_links(classes.where(F.size("embedding") == r["dims"]), r["dims"], r["count"], cosine, **tuning)
        for r in lengths
    ]
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "cls long, gained long, root long")
    for part in parts:
        found = found.union(part)
    found = stored(found, "polytope-links")
    gained = found.groupBy("cls").agg(F.sum("gained").alias("gained"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct())
    known = (
        classes.join(gained, "cls", "left")
        .join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "embedding",
            (F.col("w") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"),
            F.coalesce("component", "cls").alias("component_id"),
        )
    )
    linked = fine.join(known, "embedding").select("vec_id", "n_links", "component_id")
    # several vectors under one vec_id: links add up, the smallest component names it
    linked = linked.groupBy("vec_id").agg(
        F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    return rows.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
