"""Work on a total order of all rows, in ranges of bounded size, whatever groups the rows belong to.

Rows are split by sampled range bounds and sorted inside each range. A long or dense group covers several ranges, and what
one range needs to know of the others is one row for each range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.session import checkpointed, same_join

ROWS_PER_RANGE = 1_000_000
# Bounds come from a sample, so ranges are planned at half of what they may hold.
_SPARE = 2


def placed(rows: DataFrame, order: list[str], rows_per_range: int = ROWS_PER_RANGE, count: int | None = None) -> DataFrame:
    """Add ``_range`` and ``_place``: numbers that follow ``order`` over all rows. Null comes first.

    The result is stored, as equal rows could be placed otherwise when they are computed again. ``order`` has to tell rows
    apart where a range must not grow with their repeats.
    """
    count = rows.count() if count is None else count
    parts = max(1, -(-_SPARE * count // rows_per_range))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = checkpointed(ordered.withColumn("_place", F.monotonically_increasing_id()))
    return stored.withColumn("_range", F.shiftright("_place", 33))


def ranked(rows: DataFrame, order: list[str], name: str = "rank", start: int = 0,
           rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Number all rows by ``order`` from ``start``, without gaps: a place in its range and the sizes of those before."""
    found = placed(rows, order, rows_per_range)
    sizes = found.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row for each range, so the window and the broadcast are bounded by the number of ranges.
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_shift"))
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    numbered = found.join(F.broadcast(shifts), "_range").withColumn(name, F.col("_shift") + inside + start)
    return numbered.select(*rows.columns, name)


def nearest(found: DataFrame, by: list[str], value: Column, name: str, after: bool) -> DataFrame:
    """Add the nearest non-null ``value`` of the same group after a row, or before it, to what ``placed`` gives."""
    rows = found.withColumn("_value", value)
    direction = F.col("_place").desc() if after else F.col("_place").asc()
    passed = Window.partitionBy("_range", *by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last("_value", ignorenulls=True).over(passed)
    known = F.when(F.col("_value").isNotNull(), F.col("_place"))
    edge = F.min_by("_value", known) if after else F.max_by("_value", known)
    edges = rows.groupBy("_range", *by).agg(edge.alias("_edge"))
    others = Window.partitionBy(*by).orderBy(F.col("_range").desc() if after else F.col("_range").asc()).rowsBetween(
        Window.unboundedPreceding, -1)
    outside = edges.select("_range", *by, F.last("_edge", ignorenulls=True).over(others).alias("_outside"))
    joined = same_join(rows.withColumn("_inside", inside), outside, ["_range", *by])
    return joined.select(*found.columns, F.coalesce("_inside", "_outside").alias(name))
