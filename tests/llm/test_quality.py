import zlib

import numpy as np
from pyspark.sql import functions as F

from gleanspark.llm.quality import features, fit, of_quality, quality_of
from gleanspark.llm.queries import QUERIES
from tests.llm.cases import ROWS, no_docs, odd_docs

FOLDER = "/root/testdata/sf0.01"


def test_risk_is_minimised_and_never_rewarded_below_zero():
    random = np.random.default_rng(3)
    good, bad = random.normal(1.5, 1, (3000, 3)), random.normal(-1.5, 1, (1000, 3))
    model = fit(good[:1000], np.concatenate((good[1000:], bad)), prior=2 / 3)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.9


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id").quality
    found = QUERIES["op7_quality"](spark, FOLDER).toPandas().set_index("doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.index]).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    test = found[found.held_out].join(labels, how="inner")
    assert (test.predicted == test.quality).mean() > 0.95
    good, bad = test.score[test.quality == 1].to_numpy(), test.score[test.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_only_training_labels_and_the_text_count(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    want = quality_of(docs, labels).toPandas().sort_values("doc_id")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("?"), "source": F.lit("?"), "n_chars": F.lit(0)})
    got = quality_of(other, turned).toPandas().sort_values("doc_id")
    assert np.array_equal(want.score.to_numpy(), got.score.to_numpy())


def test_odd_rows_and_missing_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality_of(odd_docs(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality_of(odd_docs(spark), none).collect()} == {(0.5, 0)}
    assert quality_of(no_docs(spark), labels).count() == 0
    assert of_quality(odd_docs(spark), none).columns == odd_docs(spark).columns
    assert np.isfinite(features(b"")).all() and np.isfinite(features(b"\xff\x00 a")).all()
