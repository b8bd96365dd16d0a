import re
import uuid

from gleanspark.operators.paging import newest_order
from gleanspark.plans.durable import checkpoint_folder
from gleanspark.plans.positions import INDEX, ROWS, page_at, write_positions

ORDER = newest_order("at", "id", "first")


def test_many_small_files_are_written_by_few_tasks(spark):
    path = f"{checkpoint_folder(spark)}/positions-{uuid.uuid4().hex}"
    rows = spark.range(3000).selectExpr("id", "(id * 7919) % 1009 AS at").repartition(3)
    write_positions(rows, path, ORDER, 2)
    files = spark.read.parquet(f"{path}/{ROWS}").inputFiles()
    assert len(files) == 1500 and len({re.search(r"part-(\d+)-", f)[1] for f in files}) == 1
    index = sorted((r.start, r["rows"]) for r in spark.read.parquet(f"{path}/{INDEX}").collect())
    assert index == [(at, 2) for at in range(0, 3000, 2)]
    want = [r.id for r in rows.orderBy(*[o.column() for o in ORDER]).collect()]
    # names of pieces from the thousandth on have one more digit
    for skip, limit in ((0, 3), (1997, 8), (2995, 10)):
        assert [r.id for r in page_at(spark, path, ORDER, skip, limit).collect()] == want[skip : skip + limit]
