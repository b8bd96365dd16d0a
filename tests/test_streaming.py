"""Requests admitted as a stream give what admitting them one by one gives."""

import random

from pyspark.sql import functions as F

from gleanspark.streaming.intake import AdmissionIntake
from tests.test_tasks import REQUEST, admission_model, task_frame


def test_stream_admission(spark, tmp_path):
    rng = random.Random(4)
    requests = [(i, rng.randrange(15), rng.randrange(3), f"n{rng.randrange(8)}") for i in range(60)]
    existing = [(3, 1, "n1")]
    seen = task_frame(spark, [("e0", "g", "n1", '{"k": 3}', "p", "", 0, False, 1)]).withColumn(
        "task_fingerprint", F.md5(F.lit("p{'k': 3}"))
    )
    for part in range(3):
        rows = [(s, u, "p", f'{{"k": {fp}}}', n, "g") for s, fp, u, n in requests[part * 20 : part * 20 + 20]]
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={part}")
    intake = AdmissionIntake(seen, f"{tmp_path}/state")
    stream = (
        spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
        .parquet(f"{tmp_path}/in/part=*")
    )
    query = intake.start(stream, f"{tmp_path}/progress")
    query.awaitTermination(300)
    outcome = spark.read.parquet(f"{tmp_path}/state/outcome")
    assert {r["seq"]: r["reason"] for r in outcome.collect()} == admission_model(existing, requests)

    before = sorted(map(str, intake.tasks().drop("created_at", "updated_at").collect()))
    last = [r for r in requests if r[0] >= 40]
    again = spark.createDataFrame([(s, u, "p", f'{{"k": {fp}}}', n, "g") for s, fp, u, n in last], REQUEST)
    intake.admit(again, 2)  # the last batch run again changes nothing
    assert sorted(map(str, intake.tasks().drop("created_at", "updated_at").collect())) == before
