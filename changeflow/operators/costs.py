"""Usage cost roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.numbers import in_dollars, usage_cost
from changeflow.functions.times import within_days

_MEASURES = ["records_processed", "bytes_transferred", "compute_ms"]


def with_costs(usage: DataFrame) -> DataFrame:
    """Add cost columns. Usage is summed in whole numbers and priced once, so parts add up."""
    parts = usage_cost(*[F.col(m) for m in _MEASURES])
    return usage.select("*", *[c.alias(name) for name, c in parts.items()])


def hourly_usage(batches: DataFrame, ts: str = "ts") -> DataFrame:
    """Usage per config, org, target and hour.

    ``batches``: config_id, org_id, target_type, records, bytes, compute_ms and a time.
    """
    start = F.date_trunc("hour", F.col(ts).cast("timestamp"))
    return batches.groupBy("config_id", "org_id", "target_type", start.alias("period_start")).agg(
        F.sum("records").alias("records_processed"),
        F.sum("bytes").alias("bytes_transferred"),
        F.sum("compute_ms").alias("compute_ms"),
    )


def hourly_costs(batches: DataFrame, ts: str = "ts") -> DataFrame:
    hours = with_costs(hourly_usage(batches, ts))
    return hours.withColumn("period_end", F.col("period_start") + F.expr("INTERVAL 1 HOUR")).withColumn(
        "compute_seconds", F.col("compute_ms") / 1000
    )


def _recent(hours: DataFrame, now: Column, days: int, **equal: str | None) -> DataFrame:
    rows = hours.where(within_days(F.col("period_start"), now, days))
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def cost_summary(hours: DataFrame, now: Column, days: int = 30, org_id: str | None = None) -> DataFrame:
    """Usage and cost per target, and the grand total as target ``all``; dollars have four places."""
    target = F.coalesce(F.col("target_type"), F.lit("unknown"))
    rows = _recent(hours, now, days, org_id=org_id).withColumn("_target", target)
    sums = rows.rollup("_target").agg(
        *[F.sum(m).alias(m) for m in _MEASURES], F.grouping("_target").alias("_all")
    )
    label = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("_target"))
    costs = with_costs(sums.select(label.alias("target_type"), *_MEASURES))
    return costs.withColumns({c: in_dollars(F.col(c)) for c in costs.columns if c.endswith("_usd")})


def daily_costs(hours: DataFrame, now: Column, days: int = 30, config_id: str | None = None) -> DataFrame:
    """Cost per day and target, oldest day first."""
    rows = _recent(hours, now, days, config_id=config_id)
    day = F.date_trunc("day", F.col("period_start")).alias("day")
    sums = rows.groupBy(day, "target_type").agg(*[F.sum(m).alias(m) for m in _MEASURES])
    return with_costs(sums).orderBy("day", "target_type")
