"""Alert rules with cooldown, and conditions that must hold for a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.times import iso_text
from changeflow.operators import alerts
from changeflow.operators.sequence import running_totals
from changeflow.plans.inputs import LOG_SQL, at, change_log, load, samples
from changeflow.plans.metric_queries import _interpolated_sql, _COUNTS_SQL, _WINDOW_SQL
from changeflow.plans.registry import query

_ALERTS_SQL = """
SELECT event_id, ts AS at,
       CASE event_type WHEN 'error' THEN 'error_rate' WHEN 'click' THEN 'latency_breach' WHEN 'view' THEN 'hana_cpu'
            WHEN 'signup' THEN 'consumer_down' ELSE 'custom' END AS alert_type,
       CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity,
       CASE WHEN user_id % 4 > 0 THEN 'o' || (user_id % 4) END AS org_id, 'event ' || event_id AS message
FROM events
"""
# Nations serve as rules and regions as channels: a rule table of fixed size.
_RULES_SQL = """
SELECT CAST(n_nationkey AS VARCHAR) AS rule_id,
       CASE n_nationkey % 6 WHEN 0 THEN 'error_rate' WHEN 1 THEN 'latency_breach' WHEN 2 THEN 'hana_cpu'
            WHEN 3 THEN 'consumer_down' WHEN 4 THEN 'custom' ELSE 'no_such_type' END AS condition_type,
       CASE n_nationkey % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'critical' WHEN 2 THEN 'info' END AS severity_filter,
       n_regionkey AS channel_id, (n_nationkey % 5) * 45 AS cooldown_minutes,
       CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-01-05' END AS last_fired_at,
       n_nationkey % 11 <> 7 AS is_enabled, 'o' || (n_nationkey % 3 + 1) AS org_id
FROM nation
"""
_PAIRS_SQL = f"""
SELECT r.rule_id, r.channel_id, r.cooldown_minutes, e.event_id, e.alert_type, e.severity, e.message, e.at,
       r.cooldown_minutes * INTERVAL 1 MINUTE AS rest
FROM ({_ALERTS_SQL}) e JOIN ({_RULES_SQL}) r ON e.alert_type = r.condition_type
WHERE r.is_enabled AND r.channel_id <> 2 AND (e.org_id IS NULL OR e.org_id = r.org_id)
  AND r.condition_type <> 'no_such_type'
  AND (r.severity_filter IS NULL OR
       CASE e.severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END >=
       CASE r.severity_filter WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END)
  AND (r.last_fired_at IS NULL OR e.at >= r.last_fired_at + r.cooldown_minutes * INTERVAL 1 MINUTE)
"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, org = F.col("event_type"), F.col("user_id") % 4
    level = F.col("event_id") % 3
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("at"),
        F.when(kind == "error", "error_rate").when(kind == "click", "latency_breach").when(
            kind == "view", "hana_cpu").when(kind == "signup", "consumer_down").otherwise("custom").alias("alert_type"),
        F.when(level == 0, "info").when(level == 1, "warning").otherwise("critical").alias("severity"),
        F.when(org > 0, F.concat(F.lit("o"), org.cast("string"))).alias("org_id"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    kind, level = key % 6, key % 4
    return load(spark, sf_dir, "nation").select(
        key.cast("string").alias("rule_id"),
        F.when(kind == 0, "error_rate").when(kind == 1, "latency_breach").when(kind == 2, "hana_cpu").when(
            kind == 3, "consumer_down").when(kind == 4, "custom").otherwise("no_such_type").alias("condition_type"),
        F.when(level == 0, "warning").when(level == 1, "critical").when(level == 2, "info").alias("severity_filter"),
        F.col("n_regionkey").alias("channel_id"), (key % 5 * 45).alias("cooldown_minutes"),
        F.when(key % 3 == 0, at("2024-01-05")).alias("last_fired_at"), (key % 11 != 7).alias("is_enabled"),
        F.concat(F.lit("o"), (key % 3 + 1).cast("string")).alias("org_id"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = load(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("channel_id"), (F.col("r_regionkey") != 2).alias("is_active"))
    return alerts.matching_rules(_alerts(spark, sf_dir), _rules(spark, sf_dir), channels)


_FIRED_SQL = f"""
WITH RECURSIVE pairs AS MATERIALIZED ({_PAIRS_SQL}),
nxt AS MATERIALIZED (
  SELECT a.rule_id, a.event_id, b.event_id AS next_id
  FROM (SELECT x.*, x.at + x.rest AS due FROM pairs x WHERE cooldown_minutes > 0) a
  ASOF LEFT JOIN pairs b ON a.rule_id = b.rule_id AND a.due <= b.at),
fired AS (
  SELECT rule_id, arg_min(event_id, pairs.at) AS event_id FROM pairs WHERE cooldown_minutes > 0 GROUP BY rule_id
  UNION ALL
  SELECT n.rule_id, n.next_id FROM fired f JOIN nxt n ON f.rule_id = n.rule_id AND f.event_id = n.event_id
  WHERE n.next_id IS NOT NULL)
SELECT p.rule_id, p.channel_id, p.event_id, p.alert_type, p.severity, p.message, 'pending' AS delivery_status
FROM pairs p JOIN (SELECT * FROM fired UNION ALL SELECT rule_id, event_id FROM pairs WHERE cooldown_minutes = 0) f
  ON p.rule_id = f.rule_id AND p.event_id = f.event_id
"""


@query("alert_matches", f"SELECT rule_id, event_id, severity FROM ({_PAIRS_SQL})")
def alert_matches(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    ready = F.col("last_fired_at") + F.make_dt_interval(mins=F.col("cooldown_minutes"))
    return rows.where(F.col("last_fired_at").isNull() | (F.col("at") >= ready)).select("rule_id", "event_id", "severity")


@query("alert_fire", _FIRED_SQL)
def alert_fire(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    return alerts.alert_history(candidates, alerts.cooldown_firings(candidates)).drop("fired_at")


@query("alert_rules_after", f"""
SELECT r.rule_id, strftime(greatest(any_value(r.last_fired_at), max(e.at)), '%Y-%m-%dT%H:%M:%S') AS last_fired_at
FROM ({_RULES_SQL}) r LEFT JOIN ({_FIRED_SQL}) f ON r.rule_id = f.rule_id
LEFT JOIN ({_ALERTS_SQL}) e ON f.event_id = e.event_id GROUP BY r.rule_id
""")
def alert_rules_after(spark, sf_dir):
    """The clock of every rule after the firings."""
    candidates = _candidates(spark, sf_dir)
    history = alerts.alert_history(candidates, alerts.cooldown_firings(candidates))
    rules = alerts.rules_after(_rules(spark, sf_dir), history)
    return rules.select("rule_id", iso_text(F.col("last_fired_at")).alias("last_fired_at"))


def _islands_sql(rows: str, by: str, condition: str, seconds: int) -> str:
    """Runs of a condition of at least ``seconds``; ``rows`` has ``at_s``, the time in seconds."""
    return f"""
SELECT {by}, min(at_s) AS start_s, max(at_s) AS end_s, count(*) AS samples, max(at_s) - min(at_s) AS held_seconds,
       min(at_s) + {seconds} AS firing_s
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY at_us) -
                row_number() OVER (PARTITION BY {by}, ok ORDER BY at_us) AS island
      FROM (SELECT *, COALESCE({condition}, FALSE) AS ok FROM ({rows})))
WHERE ok GROUP BY {by}, island HAVING max(at_s) - min(at_s) >= {seconds}
"""


def _seconds(found: DataFrame, by: list[str]) -> DataFrame:
    return found.select(
        *by, F.unix_seconds("run_start").alias("start_s"), F.unix_seconds("run_end").alias("end_s"), "samples",
        "held_seconds", F.unix_seconds("firing_from").alias("firing_s"))


_EVENT_ROWS = """
SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS at_us, epoch_us(ts) // 1000000 AS at_s FROM events
"""


@query("alert_source_load", _islands_sql(_EVENT_ROWS, "event_type", "value > 10", 180))
def alert_source_load(spark, sf_dir):
    """A sampled load above its limit for three minutes."""
    rows = load(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return _seconds(alerts.threshold_held(rows, ["event_type"], "at", F.col("value") > 10, 180), ["event_type"])


@query("alert_consumer_down", _islands_sql(_EVENT_ROWS, "user_id", "event_type = 'error'", 60))
def alert_consumer_down(spark, sf_dir):
    """A stream's status -1 for a minute."""
    rows = load(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn(
        "code", F.when(F.col("event_type") == "error", -1).otherwise(1))
    return _seconds(alerts.threshold_held(rows, ["user_id"], "at", F.col("code") == -1, 60), ["user_id"])


_BACKLOG_ROWS = f"""
SELECT table_name, h * 3600 AS at_s, h * 3600 AS at_us, sum(n) OVER (PARTITION BY table_name ORDER BY h) AS pending
FROM (SELECT table_name, epoch_us(changed_at) // 3600000000 AS h,
             sum(CASE WHEN is_consumed THEN -2 ELSE 1 END) AS n FROM ({LOG_SQL}) GROUP BY 1, 2)
"""


@query("alert_backlog", _islands_sql(_BACKLOG_ROWS, "table_name", "pending > 5", 7200))
def alert_backlog(spark, sf_dir):
    """Backlog per hour as a running sum, above its limit for two hours."""
    hour = F.floor(F.unix_seconds("changed_at") / 3600)
    hours = change_log(spark, sf_dir).groupBy("table_name", hour.alias("h")).agg(
        F.sum(F.when(F.col("is_consumed"), -2).otherwise(1)).alias("n"))
    series = running_totals(hours, "h", {"n": "pending"}, by=["table_name"], block=168)
    series = series.withColumn("at", F.timestamp_seconds(F.col("h") * 3600))
    return _seconds(alerts.threshold_held(series, ["table_name"], "at", F.col("pending") > 5, 7200), ["table_name"])


@query("alert_error_rate", _islands_sql(
    f"SELECT window_start_s AS at_s, window_start_s AS at_us, event_type, count(*) / CAST(300 AS DOUBLE) AS r "
    f"FROM ({_WINDOW_SQL}) WHERE event_type = 'error' GROUP BY ALL", "event_type", "r > CAST(0.006 AS DOUBLE)", 120))
def alert_error_rate(spark, sf_dir):
    errors = samples(spark, sf_dir).where(F.col("event_type") == "error")
    return _seconds(alerts.error_rate_held(errors, ["event_type"], "ts", 0.006, 120), ["event_type"])


@query("alert_latency_breach", _islands_sql(
    f"SELECT event_type, window_start_s AS at_s, window_start_s AS at_us, {_interpolated_sql(0.95)} AS p95 "
    f"FROM ({_COUNTS_SQL})", "event_type", "p95 > 30000", 300))
def alert_latency_breach(spark, sf_dir):
    return _seconds(alerts.latency_breach(samples(spark, sf_dir), ["event_type"], "ts"), ["event_type"])


@query("alert_idle_streams", """
SELECT user_id AS config_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'
EXCEPT SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 36000 SECOND
  AND ts <= TIMESTAMP '2024-01-20'
""")
def alert_idle_streams(spark, sf_dir):
    """Active streams without an event in the ten hours before the given time."""
    events = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("config_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    streams = events.groupBy("config_id").agg(F.max_by("event_type", "event_id").alias("last")).select(
        "config_id", F.when(F.col("last") == "error", "error").otherwise("active").alias("status"))
    return alerts.idle_streams(streams, events, ["config_id"], "at", at("2024-01-20"), 36000).select("config_id")
