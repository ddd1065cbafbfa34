"""Epoch milliseconds, labels and look-back predicates. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")


def minute_label(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "HH:mm")


def within_days(ts: Column, now: Column, days: int) -> Column:
    return ts >= now - F.expr(f"INTERVAL {int(days)} DAYS")


def older_than(ts: Column, now: Column, age: str) -> Column:
    """Strictly older than ``age`` (such as ``1 HOUR``); false for a missing time."""
    return F.coalesce(ts < now - F.expr(f"INTERVAL {age}"), F.lit(False))


def severity_rank(level: Column) -> Column:
    """info 0, warning 1, critical 2; anything else 0."""
    return F.when(level == "critical", 2).when(level == "warning", 1).otherwise(0)
