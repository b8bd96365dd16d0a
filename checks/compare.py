"""Run queries beside their SQL and compare: ``python -m checks.compare FOLDER [NAME ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLE, QUERIES

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str, files: str = "") -> duckdb.DuckDBPyConnection:
    """Views of the given tables; ``files`` is the pattern inside a table stored as a folder."""
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet{files}')")
    return con


# Spark type -> DuckDB type
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None if Spark and DuckDB agree on ``name``, else what differs."""
    frame = QUERIES[name](spark, folder)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLE:
        return None
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    ours = {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema}
    theirs = {d[0]: str(d[1]) for d in cursor.description}
    if ours != theirs:
        return f"types {[(c, ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for ours, theirs in zip(got[1], want[1], strict=True):
        if ours != theirs:
            return f"{ours} != {theirs}"
    return None if got[1] else "no rows on either side"


def main() -> int:
    from gleanspark.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(folder)
    failed = 0
    for name in names:
        begun = time.time()
        try:
            fault = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            fault = f"{type(error).__name__}: {str(error)[:600]}"
        failed += fault is not None
        print(f"{'FAIL' if fault else 'ok  '} {name} {time.time() - begun:.2f}s {fault or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
