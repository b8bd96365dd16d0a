"""Time the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_RUNS (timed runs
after one warm-up; the median counts), BENCH_QUERIES (comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from gleanspark.session import local_session  # noqa: E402

HEADLINE = [
    "page_with_total",
    "browse_table",
    "page_desc_deep",
    "run_saved_query",
    "read_details",
    "flatten_content",
    "flatten_content_raw",
    "task_fingerprint",
    "tasks_of_owners",
    "visible_tasks",
    "task_access",
    "tasks_with_run",
    "exactly_one",
    "first_per_key",
    "dashboard_totals",
    "platform_stats",
    "admit_tasks",
    "upsert_runs",
    "patch_rows_state",
    "begin_tasks_state",
    "stop_tasks_state",
    "admit_users",
    "update_users_state",
    "unique_violations",
    "field_violations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            # every column of every row is computed and nothing is kept
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
