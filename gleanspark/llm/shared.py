"""Helpers the operators of this subpackage share: stored frames, folders, text as UTF-8 bytes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; all executors and the driver see it.

    Only a session inside one process (``local`` or ``local[n]``) may go without the setting: it
    gets a temporary folder, kept for the session. Any other session without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="gleanspark-llm-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage is cut, a lost
    executor costs nothing that was written, and only the columns in use are read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def utf8(text: Column) -> Column:
    """The bytes of a text; null gives none."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def byte_views(column: pa.Array) -> list[memoryview | bytes]:
    """A binary Arrow column as one bytes-like view per row, without copies; null gives none."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    views = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if column.null_count:
        for i in np.flatnonzero(np.asarray(column.is_null())):
            views[i] = b""
    return views


def flat_offsets(counts: np.ndarray) -> np.ndarray:
    """Where each group starts in the flat layout of groups with these sizes, and the end."""
    return np.concatenate(([0], np.cumsum(counts)))
