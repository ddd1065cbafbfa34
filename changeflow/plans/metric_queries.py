"""Latency, histograms, rates, backlog, dashboard figures and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.times import iso_text
from changeflow.operators import costs, metrics
from changeflow.operators.reports import newest as newest_rows
from changeflow.operators.status import status_code
from changeflow.plans.inputs import CHANGES_SQL, HALF, LOG_SQL, SAMPLES_SQL, at, change_log, changes, load, samples
from changeflow.plans.registry import query


def _percentile_sql(by: str) -> str:
    def at_place(q: str) -> str:
        return f"max(CASE WHEN rn = CAST(floor(CAST(n AS DOUBLE) * CAST({q} AS DOUBLE)) AS BIGINT) THEN latency_ms END)"

    return f"""
SELECT {by}, {at_place('0.5')} AS p50, {at_place('0.95')} AS p95, {at_place('0.99')} AS p99, max(latency_ms) AS max,
       count(*) AS records_in_window
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY latency_ms) - 1 AS rn,
             count(*) OVER (PARTITION BY {by}) AS n
      FROM (SELECT *, epoch_us(date_trunc('hour', ts)) // 1000000 AS hour_s FROM ({SAMPLES_SQL})))
GROUP BY {by}
"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts")))
    return samples(spark, sf_dir).withColumn("hour_s", hour)


@query("latency_percentiles", _percentile_sql("hour_s"))
def latency_percentiles(spark, sf_dir):
    return metrics.latency_percentiles(_hourly(spark, sf_dir), ["hour_s"])


@query("latency_percentiles_by_type", _percentile_sql("event_type").replace(
    "FROM (SELECT *, row_number()", "FROM (SELECT * REPLACE (NULLIF(event_type, 'view') AS event_type), row_number()").replace(
    "PARTITION BY event_type", "PARTITION BY NULLIF(event_type, 'view')"))
def latency_percentiles_by_type(spark, sf_dir):
    """Samples of one kind have no type; they are a group of their own."""
    typed = samples(spark, sf_dir).withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return metrics.latency_percentiles(typed, ["event_type"])


# Net price as a share: a double with nearly as many values as lines, all between 0 and 1.
_SHARES_SQL = """
SELECT NULLIF(l_returnflag, 'R') AS flag, l_extendedprice * (1 - l_discount) / CAST(1000000 AS DOUBLE) AS share FROM lineitem
"""


@query("percentiles_of_doubles", f"""
SELECT flag, {", ".join(f"max(CASE WHEN rn = CAST(floor(CAST(n AS DOUBLE) * CAST({q} AS DOUBLE)) AS BIGINT) THEN share END) AS {name}"
                        for name, q in metrics.QUANTILES.items())}, max(share) AS max, count(*) AS records_in_window
FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY share) - 1 AS rn, count(*) OVER (PARTITION BY flag) AS n
      FROM ({_SHARES_SQL})) GROUP BY flag
""")
def percentiles_of_doubles(spark, sf_dir):
    share = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.lit(1000000.0)
    rows = load(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("R")).alias("flag"), share.alias("share"))
    return metrics.latency_percentiles(rows, ["flag"], "share")


_BOUNDS = metrics.LATENCY_BOUNDS


@query("latency_histogram", "SELECT event_type, le, cumulative FROM (" + " UNION ALL ".join(
    f"SELECT event_type, {b} AS le, count(*) FILTER (WHERE latency_ms <= {b}) AS cumulative "
    f"FROM ({SAMPLES_SQL}) GROUP BY event_type" for b in _BOUNDS
) + f" UNION ALL SELECT event_type, NULL, count(*) FROM ({SAMPLES_SQL}) GROUP BY event_type)")
def latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(samples(spark, sf_dir), ["event_type"])


_WINDOW_SQL = f"""
SELECT event_type, (epoch_us(ts) // 15000000 - o) * 15 AS window_start_s, latency_ms
FROM ({SAMPLES_SQL}), range(0, 20) r(o)
"""


def _interpolated_sql(q: float) -> str:
    """The bucket rule as SQL text, for the check only."""
    rank = f"(CAST({q} AS DOUBLE) * le_inf)"
    parts, low, below = [], "0", "0"
    for b in _BOUNDS:
        parts.append(f"WHEN le_{b} >= {rank} THEN {low} + ({b} - {low}) * (({rank} - {below}) / (le_{b} - {below}))")
        low, below = str(b), f"le_{b}"
    return f"CASE {' '.join(parts)} ELSE CAST({_BOUNDS[-1]} AS DOUBLE) END"


_COUNTS_SQL = "SELECT event_type, window_start_s, " + ", ".join(
    f"count(*) FILTER (WHERE latency_ms <= {b}) AS le_{b}" for b in _BOUNDS
) + f", count(*) AS le_inf FROM ({_WINDOW_SQL}) GROUP BY event_type, window_start_s"


@query("histogram_quantile", "SELECT event_type, window_start_s, " + ", ".join(
    f"{_interpolated_sql(q)} AS {name}" for name, q in metrics.QUANTILES.items()) + f" FROM ({_COUNTS_SQL})")
def histogram_quantile(spark, sf_dir):
    return metrics.histogram_quantiles(samples(spark, sf_dir), ["event_type"], "ts")


@query("rates", f"""
SELECT event_type, window_start_s, count(*) AS events, count(*) / CAST(300 AS DOUBLE) AS per_second
FROM ({_WINDOW_SQL}) GROUP BY event_type, window_start_s
""")
def rates(spark, sf_dir):
    return metrics.rates(samples(spark, sf_dir), ["event_type"], "ts")


@query("sla_levels", f"""
SELECT hour_s, p95, CASE WHEN p95 > 30000 THEN 'breach' ELSE 'warning' END AS level
FROM ({_percentile_sql("hour_s")})
""")
def sla_levels(spark, sf_dir):
    rows = metrics.latency_percentiles(_hourly(spark, sf_dir), ["hour_s"], quantiles={"p95": 0.95})
    return rows.select("hour_s", "p95", metrics.sla_level(F.col("p95")).alias("level"))


@query("latency_report", f"""
SELECT strftime(make_timestamp(hour_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS window_start, p50 AS p50_latency_ms,
       p95 AS p95_latency_ms, p99 AS p99_latency_ms, max AS max_latency_ms, records_in_window
FROM ({_percentile_sql("hour_s")}) ORDER BY hour_s DESC LIMIT 100
""")
def latency_report(spark, sf_dir):
    """The newest hours under the column names of the stored metric."""
    rows = metrics.latency_percentiles(_hourly(spark, sf_dir), ["hour_s"])
    names = {f: f"{f}_latency_ms" for f in ("p50", "p95", "p99", "max")}
    newest = newest_rows(rows.withColumnsRenamed(names), "hour_s", "hour_s", 100)
    return newest.withColumn("window_start", iso_text(F.timestamp_seconds("hour_s"))).drop("hour_s")


# One stream per user: its status follows from its newest event.
_STREAMS_SQL = f"""
SELECT CAST(user_id AS VARCHAR) AS config_id,
       CASE arg_max(event_type, event_id) WHEN 'error' THEN 'error' WHEN 'view' THEN 'paused' ELSE 'active' END
         AS status,
       CASE WHEN arg_max(event_type, event_id) = 'error' AND user_id % 3 > 0 THEN 'event ' || max(event_id) END
         AS error_message,
       count(*) AS records_processed_total,
       CASE WHEN user_id % 4 > 0 THEN CAST(sum(latency_ms) // count(*) AS BIGINT) END AS avg_latency_ms
FROM ({SAMPLES_SQL}) GROUP BY user_id
"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = samples(spark, sf_dir).groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last"), F.max("event_id").alias("newest"), F.count("*").alias("n"),
        F.sum("latency_ms").alias("total"))
    broken = (F.col("last") == "error") & (F.col("user_id") % 3 > 0)
    mean = F.floor(F.col("total") / F.col("n"))
    return grouped.select(
        F.col("user_id").cast("string").alias("config_id"),
        F.when(F.col("last") == "error", "error").when(F.col("last") == "view", "paused").otherwise("active").alias(
            "status"),
        F.when(broken, F.concat(F.lit("event "), F.col("newest").cast("string"))).alias("error_message"),
        F.col("n").alias("records_processed_total"),
        F.when(F.col("user_id") % 4 > 0, mean).alias("avg_latency_ms"))


@query("kpis", f"""
SELECT count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'error') AS errors,
       count(*) AS streams, CAST(sum(records_processed_total) AS BIGINT) AS records,
       CAST(floor(sum(COALESCE(avg_latency_ms, 0)) / greatest(count(*) FILTER (WHERE avg_latency_ms <> 0), 1) + 0.5)
         AS BIGINT) AS avg_latency_ms
FROM ({_STREAMS_SQL})
""")
def kpis(spark, sf_dir):
    return metrics.dashboard_kpis(_streams(spark, sf_dir))


@query("dashboard_alerts", f"""
SELECT config_id, 'error' AS level, error_message AS text FROM ({_STREAMS_SQL})
WHERE status = 'error' AND error_message <> ''
UNION ALL
SELECT config_id, 'warn', 'High latency: ' || avg_latency_ms || 'ms' FROM ({_STREAMS_SQL}) WHERE avg_latency_ms > 25000
""")
def dashboard_alerts(spark, sf_dir):
    return metrics.dashboard_alerts(_streams(spark, sf_dir))


@query("stream_status", f"""
SELECT config_id, status, CASE status WHEN 'error' THEN -1 WHEN 'paused' THEN 0 ELSE 1 END AS code
FROM ({_STREAMS_SQL})
""")
def stream_status(spark, sf_dir):
    return _streams(spark, sf_dir).select("config_id", "status", status_code(F.col("status")).alias("code"))


_TARGET = "CASE event_id % 4 WHEN 0 THEN 'columnar' WHEN 1 THEN 'document' WHEN 2 THEN 'relational' END"

_THROUGHPUT_SQL = f"""
SELECT COALESCE({_TARGET}, 'unknown') AS target_type, user_id AS config_id, date_trunc('minute', ts) AS window_end,
       count(*) AS records_in_window
FROM events GROUP BY ALL
"""


def _throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("target_type", F.coalesce(_target(), F.lit("unknown")))
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("window_end")
    return rows.groupBy("target_type", F.col("user_id").alias("config_id"), minute).agg(
        F.count("*").alias("records_in_window"))


def _target():
    kind = F.col("event_id") % 4
    return F.when(kind == 0, "columnar").when(kind == 1, "document").when(kind == 2, "relational")


@query("throughput_pivot", f"""
WITH n AS (SELECT *, strftime(window_end, '%H:%M') AS label FROM ({_THROUGHPUT_SQL})
           ORDER BY window_end DESC, config_id DESC, target_type DESC LIMIT 30)
SELECT label,
       arg_max(records_in_window, (window_end, config_id)) FILTER (WHERE target_type = 'columnar') AS columnar,
       arg_max(records_in_window, (window_end, config_id)) FILTER (WHERE target_type = 'document') AS document,
       arg_max(records_in_window, (window_end, config_id)) FILTER (WHERE target_type = 'relational') AS relational,
       arg_max(records_in_window, (window_end, config_id)) FILTER (WHERE target_type = 'unknown') AS unknown
FROM n GROUP BY label
""")
def throughput_pivot(spark, sf_dir):
    return metrics.throughput_matrix(
        _throughput(spark, sf_dir), ["columnar", "document", "relational", "unknown"])


@query("backlog", f"""
SELECT table_name, count(*) AS total, count(*) FILTER (WHERE NOT is_consumed) AS pending
FROM ({LOG_SQL}) GROUP BY table_name
""")
def backlog(spark, sf_dir):
    return metrics.backlog(change_log(spark, sf_dir), ["table_name"])


@query("lag", f"""
SELECT table_name, max(seq) AS high_watermark,
       COALESCE(max(CASE WHEN changed_at < TIMESTAMP '{HALF}' AND table_name IS DISTINCT FROM 'events_1' THEN seq END), 0)
         AS current_offset,
       max(seq) - COALESCE(max(CASE WHEN changed_at < TIMESTAMP '{HALF}' AND table_name IS DISTINCT FROM 'events_1' THEN seq END), 0)
         AS lag
FROM (SELECT * REPLACE (NULLIF(table_name, 'events_3') AS table_name) FROM ({CHANGES_SQL})) GROUP BY table_name
""")
def lag(spark, sf_dir):
    """Lag per table; one has no name."""
    rows = changes(spark, sf_dir).withColumn("table_name", F.nullif("table_name", F.lit("events_3")))
    applied = rows.where((F.col("changed_at") < at(HALF)) & ~F.col("table_name").eqNullSafe("events_1"))
    state = applied.groupBy("table_name").agg(F.max("seq").alias("last_seq"))
    return metrics.consumer_lag(rows, state, ["table_name"], seq="seq")


_BATCHES_SQL = f"""
SELECT 'c' || user_id AS config_id, 'o' || (user_id % 10) AS org_id, {_TARGET} AS target_type,
       (event_id * 31) % 5000 + 1 AS records, (event_id * 104729) % 50000000 AS bytes,
       (event_id * 7919) % 60000 AS compute_ms, ts
FROM events
"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("config_id"),
        F.concat(F.lit("o"), (F.col("user_id") % 10).cast("string")).alias("org_id"),
        _target().alias("target_type"), ((key * 31) % 5000 + 1).alias("records"),
        ((key * 104729) % 50000000).alias("bytes"), ((key * 7919) % 60000).alias("compute_ms"),
        F.col("ts").cast("timestamp").alias("ts"))


# Dollars with four places by whole numbers: each component and the sum of all in parts of one denominator.
_PARTS_SQL = {"records_usd": "records_processed::HUGEINT * 150994944", "transfer_usd": "bytes_transferred::HUGEINT * 28125",
              "compute_usd": "compute_ms::HUGEINT * 4194304"}
_PARTS_SQL["cost_usd"] = " + ".join(_PARTS_SQL.values())
_COST_COLUMNS = ", ".join(
    f"CAST((2 * ({parts}) + 30198988800) // 60397977600 AS DOUBLE) / 10000 AS {name}" for name, parts in _PARTS_SQL.items())
_SUMS = ", ".join(f"CAST(sum({a}) AS BIGINT) AS {b}" for a, b in (
    ("records", "records_processed"), ("bytes", "bytes_transferred"), ("compute_ms", "compute_ms")))
_NOW = "2024-01-31"


def _as_doubles(rows: DataFrame) -> DataFrame:
    """Decimal dollars as doubles, which the checks compare."""
    return rows.withColumns({c: F.col(c).cast("double") for c in rows.columns if c.endswith("_usd")})


@query("cost_hourly", f"""
SELECT config_id, org_id, target_type, strftime(h, '%Y-%m-%dT%H:%M:%S') AS period_start,
       strftime(h + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS period_end, records_processed, bytes_transferred,
       compute_ms, CAST(compute_ms AS DOUBLE) / 1000 AS compute_seconds, {_COST_COLUMNS}
FROM (SELECT config_id, org_id, target_type, date_trunc('hour', ts) AS h, {_SUMS} FROM ({_BATCHES_SQL}) GROUP BY ALL)
""")
def cost_hourly(spark, sf_dir):
    hours = _as_doubles(costs.hourly_costs(_batches(spark, sf_dir)))
    return hours.withColumn("period_start", iso_text(F.col("period_start"))).withColumn(
        "period_end", iso_text(F.col("period_end")))


@query("cost_summary", f"""
SELECT target_type, records_processed, bytes_transferred, compute_ms, {_COST_COLUMNS} FROM (
  SELECT COALESCE(target_type, 'unknown') AS target_type, {_SUMS} FROM ({_BATCHES_SQL})
  WHERE org_id = 'o3' AND date_trunc('hour', ts) >= TIMESTAMP '{_NOW}' - INTERVAL 20 DAY GROUP BY 1
  UNION ALL SELECT 'all', {_SUMS} FROM ({_BATCHES_SQL})
  WHERE org_id = 'o3' AND date_trunc('hour', ts) >= TIMESTAMP '{_NOW}' - INTERVAL 20 DAY)
""")
def cost_summary(spark, sf_dir):
    hours = costs.hourly_usage(_batches(spark, sf_dir))
    return costs.cost_summary(hours, at(_NOW), days=20, org_id="o3")


@query("cost_daily", f"""
SELECT strftime(day, '%Y-%m-%dT%H:%M:%S') AS day, target_type, records_processed, bytes_transferred, compute_ms,
       {_COST_COLUMNS}
FROM (SELECT date_trunc('day', ts) AS day, target_type, {_SUMS} FROM ({_BATCHES_SQL})
      WHERE date_trunc('hour', ts) >= TIMESTAMP '{_NOW}' - INTERVAL 20 DAY GROUP BY ALL)
""")
def cost_daily(spark, sf_dir):
    days = costs.daily_costs(costs.hourly_usage(_batches(spark, sf_dir)), at(_NOW), days=20)
    return _as_doubles(days).withColumn("day", iso_text(F.col("day")))
