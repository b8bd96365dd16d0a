"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.bpe import round_trip
from gleanspark.llm.decontaminate import without_contaminated
from gleanspark.llm.near_copies import one_of_each
from gleanspark.llm.quality import of_quality
from gleanspark.llm.queries import SURROGATE_KEY
from gleanspark.llm.shared import shared_folder
from gleanspark.llm.surrogates import with_surrogates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, fitted on this input, does not reject."""
    return of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one with the smallest doc_id."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates and ``n_chars`` set to the new length."""
    return with_surrogates(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, decoded_text``: token ids, and the text they stand for."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = round_trip(docs, path, public_tokenizers.PATTERN, kept=["doc_id", "lang", "source"])
    return coded.withColumn("decoded_text", F.col("decoded").cast("string")).drop("decoded")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
# a classifier, a hash search and keyed surrogates are beyond SQL; tests hold stages to models
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents`` of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
