"""Fix a frame's rows once, on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster session
    without it is an error, since a folder on one machine is no shared storage.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="gleanspark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    For rounds: a checkpoint hands on what the planner has inferred about its rows, and that
    doubles from round to round; a table carries nothing over.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage at a reliable checkpoint.

    Used where several outputs must agree on the same decisions and between the
    rounds of an iterative operator.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)
