"""Streaming metrics: deduplicated logs, hourly usage, latency windows and panes of rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.operators.metrics import bucket_counts


def deduplicated(log: DataFrame, by: list[str], ts: str = "changed_at", late: str = "1 hour") -> DataFrame:
    """Drop repeats of a sequence number that arrive within ``late`` of each other."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(by)


def hourly_usage(batches: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Usage per config, org, target and hour, with true window bounds."""
    window = F.window(ts, "1 hour").alias("w")
    sums = batches.withWatermark(ts, late).groupBy("config_id", "org_id", "target_type", window).agg(
        F.sum("records").alias("records_processed"),
        F.sum("bytes").alias("bytes_transferred"),
        F.sum("compute_ms").alias("compute_ms"),
    )
    return sums.select(
        "config_id", "org_id", "target_type", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
        "records_processed", "bytes_transferred", "compute_ms",
    )


def latency_windows(samples: DataFrame, by: list[str], ts: str, value: str = "latency_ms",
                    length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Bucket counts per tumbling window; state per group is twelve counters."""
    window = F.window(ts, length).alias("w")
    counts = samples.withWatermark(ts, late).groupBy(*by, window).agg(*bucket_counts(value), F.max(value).alias("max"))
    return counts.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         *[c for c in counts.columns if c not in (*by, "w")])


def event_panes(events: DataFrame, by: list[str], ts: str, slide: str = "15 seconds",
                late: str = "10 minutes") -> DataFrame:
    """Events per tumbling pane; ``metrics.rates_of_panes`` turns stored panes into sliding rates.

    A sliding window over the stream itself would copy each event into all the windows that hold it.
    """
    window = F.window(ts, slide).alias("w")
    counts = events.withWatermark(ts, late).groupBy(*by, window).agg(F.count("*").alias("events"))
    return counts.select(*by, F.col("w.start").alias("pane_start"), "events")
