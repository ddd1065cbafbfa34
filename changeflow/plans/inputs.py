"""Inputs derived from the given tables, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SQL = """
SELECT event_id AS seq_id,
       CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op_type,
       CAST(user_id AS VARCHAR) || '|' || CAST(event_id % 7 AS VARCHAR) AS row_key,
       ts AS changed_at,
       CASE WHEN event_type = 'error' THEN NULL ELSE props END AS changed_fields,
       event_id % 3 = 0 AS is_consumed,
       'events_' || CAST(user_id % 5 AS VARCHAR) AS table_name,
       event_type, value
FROM events
"""

# The change stream of the log: one effective change per row, with the single field ``k``.
CHANGES_SQL = f"""
SELECT row_key, op_type AS op, epoch_us(changed_at) // 1000 AS ts_ms, seq_id AS seq, changed_at, table_name, event_type,
       json_extract_string(changed_fields, '$.k') AS k
FROM ({LOG_SQL})
"""

SAMPLES_SQL = """
SELECT event_id, event_type, user_id, ts, (event_id * 7919) % 60000 AS latency_ms FROM events
"""

# Half of the log's time span: the target holds what came before, the batch what came after.
HALF = "2024-01-16"
NOW = "2024-01-15"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_of(events: DataFrame) -> DataFrame:
    """``events`` as a change log: signup inserts, error deletes, the rest updates."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq_id"),
        F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U").alias("op_type"),
        F.concat_ws("|", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("row_key"),
        F.col("ts").cast("timestamp").alias("changed_at"),
        F.when(kind != "error", F.col("props")).alias("changed_fields"),
        (F.col("event_id") % 3 == 0).alias("is_consumed"),
        F.concat(F.lit("events_"), (F.col("user_id") % 5).cast("string")).alias("table_name"),
        "event_type",
        "value",
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(load(spark, sf_dir, "events"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a change stream; the payload has one declared column, so no map is built."""
    k = F.from_json("changed_fields", "k string")["k"]
    return change_log(spark, sf_dir).select(
        "row_key", F.col("op_type").alias("op"), F.unix_millis("changed_at").alias("ts_ms"),
        F.col("seq_id").alias("seq"), "changed_at", "table_name", "event_type", k.alias("k"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples of the events."""
    return load(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_id") * 7919) % 60000).alias("latency_ms"),
    )


def at(text: str):
    return F.lit(text).cast("timestamp")
