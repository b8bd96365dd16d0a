"""Task requests admitted as they arrive, in micro-batches.

A console admits one request per call. Here a stream of request rows is admitted batch
after batch with the operator for batches, each batch seeing what earlier ones admitted.
Accepted rows are only ever added, one folder per batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanspark.operators.tasks import admit_tasks
from gleanspark.sources.schemas import TASK_COLUMNS
from gleanspark.sources.tables import MISSING


class AdmissionIntake:
    """Admission of a request stream into ``root/task``, outcomes in ``root/outcome``.

    ``existing`` is the task table before the stream starts; it is read, never copied.
    """

    def __init__(self, existing: DataFrame, root: str):
        self.existing = existing.select(*TASK_COLUMNS)
        self.root = root

    def tasks(self, before: int | None = None) -> DataFrame:
        """All tasks, or those known before a batch."""
        spark = self.existing.sparkSession
        try:
            admitted = spark.read.parquet(f"{self.root}/task")
        except AnalysisException as fault:
            if fault.getCondition() in MISSING:
                return self.existing
            raise
        if before is not None:
            admitted = admitted.where(F.col("batch") < before)
        return self.existing.unionByName(admitted.select(*TASK_COLUMNS))

    def admit(self, requests: DataFrame, batch: int) -> None:
        """Admit one batch. A batch run again after a failure sees the same tasks and writes
        the same folders, so nothing is admitted twice."""
        decided = admit_tasks(requests, self.tasks(before=batch))
        rows = decided.accepted.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.existing.schema]
        )
        rows.write.mode("overwrite").parquet(f"{self.root}/task/batch={batch}")
        decided.outcomes.write.mode("overwrite").parquet(f"{self.root}/outcome/batch={batch}")

    def start(self, requests: DataFrame, progress: str, available_now: bool = True) -> StreamingQuery:
        """Run the intake over a streaming frame; ``progress`` is the stream's checkpoint folder."""
        writer = requests.writeStream.foreachBatch(self.admit).option("checkpointLocation", progress)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
