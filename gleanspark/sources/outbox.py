"""Publishing records: an outbox of payloads, and outcomes from the channel's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.display import (
    UNREACHABLE_MESSAGE,
    outcome_message,
    publish_failed_message,
    published_message,
)
from gleanspark.plans.skew import lookup_join

PUBLISHED, CHANNEL_ERROR, UNREACHABLE = 200, 502, 503
CHANNELS = {"test": False, "alpha": True}


def publish_outbox(records: DataFrame, table_name: Column | str, channel: str, key: str = "id") -> DataFrame:
    """One payload per record: ``record_id``, ``table_name`` and the JSON body."""
    name = F.lit(table_name) if isinstance(table_name, str) else table_name
    body = F.struct(
        name.alias("table_name"), F.col(key).alias("record_id"), F.lit(CHANNELS[channel]).alias("is_alpha")
    )
    return records.select(F.col(key).alias("record_id"), name.alias("table_name"), F.to_json(body).alias("payload"))


def write_outbox(outbox: DataFrame, path: str) -> None:
    """Store payloads as JSON lines for the sender."""
    outbox.write.mode("append").json(path)


def publish_outcome(outbox: DataFrame, responses: DataFrame) -> DataFrame:
    """Outcome per payload: 200 is published, another status 502, no answer 503.

    ``responses`` has at most one row per ``record_id`` with ``status_code`` and ``text``.
    """
    answered = lookup_join(outbox, responses.select("record_id", "status_code", "text"), "record_id", unique=True)
    outcome = (
        F.when(F.col("status_code").isNull(), F.lit(UNREACHABLE))
        .when(F.col("status_code") == 200, F.lit(PUBLISHED))
        .otherwise(F.lit(CHANNEL_ERROR))
    )
    messages = {
        PUBLISHED: published_message("table_name", "record_id"),
        CHANNEL_ERROR: publish_failed_message("text"),
        UNREACHABLE: F.lit(UNREACHABLE_MESSAGE),
    }
    return (
        answered.withColumn("outcome", outcome)
        .withColumn("message", outcome_message("outcome", messages))
        .select("record_id", "table_name", "outcome", "message")
    )
