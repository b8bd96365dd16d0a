"""Column layouts of the metadata tables. Article tables have no fixed layout."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "smallint": T.ShortType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: dict[str, str]) -> T.StructType:
    """Layout from ``name: type``; a ``?`` after the type allows NULL."""
    return T.StructType(
        [T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")) for name, kind in columns.items()]
    )


# The columns of each table.
USER = _schema(
    {
        "id": "string",
        "email": "string",
        "is_active": "boolean",
        "is_superuser": "boolean",
        "full_name": "string?",
        "hashed_password": "string",
        "created_at": "timestamp?",
    }
)
TASK = _schema(
    {
        "id": "string",
        "task_group": "string",
        "task_name": "string",
        "task_content": "string",
        "source_platform": "string",
        "task_fingerprint": "string",
        "status": "smallint",
        "is_delete": "boolean",
        "created_at": "timestamp?",
        "updated_at": "timestamp?",
        "user_id": "string",
    }
)
TASK_RUN = _schema(
    {
        "id": "string",
        "task_fingerprint": "string",
        "source_platform": "string",
        "priority": "smallint",
        "cron_expr": "string",
        "crawl_task": "string",
        "status": "smallint",
        "error_reason": "string?",
        "enabled": "boolean",
        "started_at": "timestamp?",
        "finished_at": "timestamp?",
    }
)
RULE = _schema(
    {
        "id": "string",
        "source_platform": "string",
        "form_rule": "string",
        "crawl_rule": "string",
        "enabled": "boolean",
        "created_at": "timestamp?",
        "updated_at": "timestamp?",
    }
)
DATA_QUERY_CONFIG = _schema(
    {
        "id": "string",
        "name": "string",
        "db_name": "string",
        "table_name": "string",
        "db_uri": "string?",
        "enabled": "boolean",
        "created_at": "timestamp?",
        "updated_at": "timestamp?",
    }
)
DATA_QUERY = _schema(
    {
        "id": "string",
        "name": "string",
        "sql": "string",
        "config_id": "string",
        "enabled": "boolean",
        "created_at": "timestamp?",
        "updated_at": "timestamp?",
    }
)

SCHEMAS = {
    "user": USER,
    "task": TASK,
    "task_run": TASK_RUN,
    "rule": RULE,
    "data_query_config": DATA_QUERY_CONFIG,
    "data_query": DATA_QUERY,
}

TASK_COLUMNS = TASK.fieldNames()
RUN_COLUMNS = TASK_RUN.fieldNames()
USER_COLUMNS = USER.fieldNames()

# Columns that identify a row for business purposes and must be unique.
UNIQUE_KEYS = {
    "user": ("id", "email"),
    "task": ("id", "task_fingerprint"),
    "task_run": ("id", "task_fingerprint"),
    "rule": ("id", "source_platform"),
    "data_query_config": ("id", "name"),
    "data_query": ("id", "name"),
}
