"""Change log: poll, decode, envelope, publish, parse, acknowledge, purge, capture, sequence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import sequence
from changeflow.operators.metrics import message_counts
from changeflow.plans.inputs import LOG_SQL, NOW, at, change_log, load
from changeflow.plans.registry import query
from changeflow.sources import changelog, messages

KEY_FIELDS = ["user_id", "shard", "region"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = changelog.decode(change_log(spark, sf_dir))
    return changelog.envelope(decoded, "src", "Shop", "Events", KEY_FIELDS)


@query("log_poll", f"""
SELECT seq_id, op_type, row_key, epoch_us(changed_at) // 1000 AS ts_ms, changed_fields FROM ({LOG_SQL})
WHERE NOT is_consumed AND seq_id > 500 ORDER BY seq_id LIMIT 1000
""")
def log_poll(spark, sf_dir):
    rows = changelog.poll(change_log(spark, sf_dir), last_seq=500, limit=1000)
    return rows.select("seq_id", "op_type", "row_key", F.unix_millis("changed_at").alias("ts_ms"), "changed_fields")


@query("log_poll_all", f"""
SELECT seq_id, op_type, row_key FROM ({LOG_SQL}) WHERE NOT is_consumed AND seq_id > 500
""")
def log_poll_all(spark, sf_dir):
    return changelog.poll(change_log(spark, sf_dir), last_seq=500, limit=None).select("seq_id", "op_type", "row_key")


@query("log_decode", f"""
WITH broken AS (
  SELECT *, CASE WHEN seq_id % 10 = 1 THEN left(changed_fields, 4) WHEN seq_id % 10 = 2 THEN '' ELSE changed_fields
            END AS raw
  FROM ({LOG_SQL}))
SELECT seq_id, CASE WHEN seq_id % 10 NOT IN (1, 2) THEN json_extract_string(raw, '$.k') END AS k,
       seq_id % 10 IN (1, 2) OR raw IS NULL AS fields_missing,
       epoch_us(CASE WHEN seq_id % 20 = 5 THEN TIMESTAMP '2024-02-01' ELSE changed_at END) // 1000 AS ts_ms
FROM broken
""")
def log_decode(spark, sf_dir):
    log = change_log(spark, sf_dir)
    digit = F.col("seq_id") % 10
    raw = F.when(digit == 1, F.left("changed_fields", F.lit(4))).when(digit == 2, F.lit(""))
    broken = log.withColumn("changed_fields", raw.otherwise(F.col("changed_fields"))).withColumn(
        "changed_at", F.when(F.col("seq_id") % 20 != 5, F.col("changed_at")))
    decoded = changelog.decode(broken, now=at("2024-02-01"))
    return decoded.select(
        "seq_id", F.try_element_at("fields", F.lit("k")).alias("k"),
        F.col("fields").isNull().alias("fields_missing"), "ts_ms")


@query("log_envelope", f"""
SELECT 'src' AS source, 'Shop' AS "schema", 'Events' AS "table", op_type AS op,
       split_part(row_key, '|', 1) AS key_user, NULLIF(split_part(row_key, '|', 2), '') AS key_shard,
       NULLIF(split_part(row_key, '|', 3), '') AS key_region,
       CAST(NULL AS VARCHAR) AS before_k,
       CASE WHEN op_type <> 'D' THEN json_extract_string(changed_fields, '$.k') END AS after_k,
       op_type = 'D' AS after_missing, epoch_us(changed_at) // 1000 AS ts_ms, seq_id AS seq
FROM ({LOG_SQL})
""")
def log_envelope(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "source", "schema", "table", "op",
        F.col("key")["user_id"].alias("key_user"), F.col("key")["shard"].alias("key_shard"),
        F.col("key")["region"].alias("key_region"), F.col("before")["k"].alias("before_k"),
        F.col("after")["k"].alias("after_k"), F.col("after").isNull().alias("after_missing"), "ts_ms", "seq")


@query("event_parse_deadletter", f"""
SELECT seq_id, CASE WHEN seq_id % 11 = 0 THEN 'malformed' WHEN seq_id % 13 = 0 THEN 'missing op' END AS parse_error,
       CASE WHEN seq_id % 11 <> 0 AND seq_id % 13 <> 0 THEN op_type END AS op,
       CASE WHEN seq_id % 11 <> 0 THEN split_part(row_key, '|', 1) END AS key_user,
       CASE WHEN seq_id % 11 <> 0 AND op_type <> 'D' THEN json_extract_string(changed_fields, '$.k') END AS after_k,
       CASE WHEN seq_id % 11 <> 0 THEN epoch_us(changed_at) // 1000 END AS ts_ms
FROM ({LOG_SQL})
""")
def event_parse_deadletter(spark, sf_dir):
    decoded = changelog.decode(change_log(spark, sf_dir))
    events = changelog.envelope(decoded, "src", "Shop", "Events", KEY_FIELDS)
    value = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"})
    texts = events.select(F.col("seq").alias("seq_id"), value.alias("value"))
    broken = F.when(F.col("seq_id") % 11 == 0, F.left("value", F.lit(30))).when(
        F.col("seq_id") % 13 == 0, F.replace(F.col("value"), F.lit('"op":'), F.lit('"xp":')))
    parsed = messages.parse(texts.withColumn("value", broken.otherwise(F.col("value"))))
    return parsed.select(
        "seq_id", "parse_error", "op", F.try_element_at("key", F.lit("user_id")).alias("key_user"),
        F.try_element_at("after", F.lit("k")).alias("after_k"), "ts_ms")


@query("partition_key", f"""
SELECT seq_id AS seq, 'cdc.shop.events' AS topic,
       md5(CASE WHEN split_part(row_key, '|', 1) <= split_part(row_key, '|', 2) THEN row_key
                ELSE split_part(row_key, '|', 2) || '|' || split_part(row_key, '|', 1) END) AS key_digest
FROM ({LOG_SQL})
""")
def partition_key(spark, sf_dir):
    decoded = changelog.decode(change_log(spark, sf_dir))
    events = changelog.envelope(decoded, "src", "Shop", "Events", KEY_FIELDS[:2])
    records = messages.to_records(events)
    seq = F.get_json_object("value", "$.seq").cast("bigint")
    return records.select(seq.alias("seq"), "topic", F.lower(F.hex("key")).alias("key_digest"))


@query("message_counts", f"""
SELECT 'cdc.shop.' || table_name AS topic, op_type, count(*) AS messages FROM ({LOG_SQL}) GROUP BY ALL
""")
def message_counts_by_topic(spark, sf_dir):
    log = change_log(spark, sf_dir)
    topic = F.lower(F.concat_ws(".", F.lit("cdc"), F.lit("Shop"), F.col("table_name")))
    return message_counts(log.withColumn("topic", topic), ["topic", "op_type"])


@query("mark_consumed", f"""
SELECT seq_id, is_consumed OR seq_id % 5 = 0 AS is_consumed FROM ({LOG_SQL})
""")
def mark_consumed(spark, sf_dir):
    log = change_log(spark, sf_dir)
    delivered = log.where(F.col("seq_id") % 5 == 0).select("table_name", "seq_id")
    return changelog.mark_consumed(log, delivered).select("seq_id", "is_consumed")


@query("purge", f"""
SELECT seq_id FROM ({LOG_SQL})
WHERE NOT (is_consumed AND changed_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)
""")
def purge(spark, sf_dir):
    return changelog.purge(change_log(spark, sf_dir), at(NOW)).select("seq_id")


@query("purge_counts", f"""
SELECT table_name, count(*) FILTER (WHERE is_consumed AND changed_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS purged,
       count(*) FILTER (WHERE NOT (is_consumed AND changed_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)) AS kept
FROM ({LOG_SQL}) GROUP BY table_name
""")
def purge_counts(spark, sf_dir):
    return changelog.purge_counts(change_log(spark, sf_dir), at(NOW), ["table_name"])


_DIFF_SQL = """
SELECT o_orderkey, op_type, CAST(o_orderkey AS VARCHAR) AS row_key,
       CASE WHEN op_type <> 'D' THEN
         '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' ||
         o_orderpriority || '"}' END AS changed_fields
FROM (SELECT *, CASE WHEN o_orderkey % 10 = 3 THEN 'I' WHEN o_orderkey % 10 = 7 THEN 'D'
                     WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'O' THEN 'U' END AS op_type FROM orders)
WHERE op_type IS NOT NULL
"""


def _order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    old = orders.where(key % 10 != 3).withColumn(
        "o_orderstatus", F.when(key % 4 == 0, F.lit("O")).otherwise(F.col("o_orderstatus")))
    new = orders.where(key % 10 != 7)
    return changelog.capture(old, new, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("snapshot_diff", _DIFF_SQL)
def snapshot_diff(spark, sf_dir):
    return _order_changes(spark, sf_dir)


@query("capture_sequence", f"""
SELECT o_orderkey, op_type, row_number() OVER (ORDER BY o_orderkey DESC) + 99 AS seq_id FROM ({_DIFF_SQL})
""")
def capture_sequence(spark, sf_dir):
    """Captured changes numbered from 100, newest order first."""
    ordered = _order_changes(spark, sf_dir).withColumn("newest", -F.col("o_orderkey"))
    return changelog.number_changes(ordered, ["newest"], start=100).select("o_orderkey", "op_type", "seq_id")


_HOLED_SQL = f"""
SELECT NULLIF(table_name, 'events_3') AS table_name, seq_id FROM ({LOG_SQL}) WHERE seq_id % 17 NOT IN (3, 4)
UNION ALL SELECT NULLIF(table_name, 'events_3'), seq_id FROM ({LOG_SQL}) WHERE seq_id % 19 = 0
"""


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with holes and repeats; one series has no name."""
    log = change_log(spark, sf_dir).select(F.nullif("table_name", F.lit("events_3")).alias("table_name"), "seq_id")
    return log.where(~(F.col("seq_id") % 17).isin(3, 4)).unionByName(log.where(F.col("seq_id") % 19 == 0))


@query("seq_check", f"""
SELECT table_name, after_seq, seq_id AS next_seq, seq_id - after_seq - 1 AS missing
FROM (SELECT table_name, seq_id, lag(seq_id) OVER (PARTITION BY table_name ORDER BY seq_id) AS after_seq
      FROM (SELECT DISTINCT * FROM ({_HOLED_SQL})))
WHERE seq_id - after_seq > 1
""")
def seq_check(spark, sf_dir):
    return sequence.sequence_gaps(_holed(spark, sf_dir), ["table_name"])


@query("seq_summary", f"""
SELECT table_name, count(*) AS row_count, count(*) - count(DISTINCT seq_id) AS repeated, min(seq_id) AS first_seq,
       max(seq_id) AS last_seq, max(seq_id) - min(seq_id) + 1 - count(DISTINCT seq_id) AS missing,
       (max(seq_id) - min(seq_id) + 1 = count(DISTINCT seq_id)) AND count(*) = count(DISTINCT seq_id) AS gap_free
FROM ({_HOLED_SQL}) GROUP BY table_name
""")
def seq_summary(spark, sf_dir):
    return sequence.sequence_summary(_holed(spark, sf_dir), ["table_name"])
