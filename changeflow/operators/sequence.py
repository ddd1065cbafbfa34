"""Order-dependent operators that never put a whole series into one task.

Each works in two steps: inside blocks of the order column, then over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.session import checkpointed, same_join


def running_totals(rows: DataFrame, order: str, totals: dict[str, str], by: list[str] | None = None,
                   block: int = 4096) -> DataFrame:
    """Add running sums of columns (input name to output name) along a whole-number column."""
    by = by or []
    blocked = rows.withColumn("_block", F.expr(f"`{order}` div {block}"))
    sums = blocked.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        *by, "_block", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in totals]
    )
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = same_join(blocked, shifts, [*by, "_block"])
    for column, name in totals.items():
        joined = joined.withColumn(name, F.col(f"_before_{column}") + F.sum(column).over(inside))
    return joined.drop("_block", *[f"_before_{c}" for c in totals])


def sequence_gaps(log: DataFrame, by: list[str], seq: str = "seq_id", block: int = 1_000_000) -> DataFrame:
    """Holes in a sequence: the number before, the number after, how many are missing."""
    present = log.select(*by, seq).distinct().withColumn("_block", F.floor(F.col(seq) / block))
    edges = present.groupBy(*by, "_block").agg(F.max(seq).alias("_last"))
    previous = F.lag("_last").over(Window.partitionBy(*by).orderBy("_block"))
    entry = edges.select(*by, "_block", previous.alias("_entry"))
    inside = F.lag(seq).over(Window.partitionBy(*by, "_block").orderBy(seq))
    rows = same_join(present, entry, [*by, "_block"]).withColumn("after_seq", F.coalesce(inside, F.col("_entry")))
    missing = F.col(seq) - F.col("after_seq") - 1
    return rows.select(*by, "after_seq", F.col(seq).alias("next_seq"), missing.alias("missing")).where(missing > 0)


def sequence_summary(log: DataFrame, by: list[str], seq: str = "seq_id") -> DataFrame:
    """Per series: rows, repeated rows, bounds, missing numbers, and whether it is gap-free.

    Rows are collapsed per number first, so repeats never reach the second step.
    """
    numbers = log.groupBy(*by, seq).agg(F.count("*").alias("_copies"))
    summary = numbers.groupBy(*by).agg(
        F.sum("_copies").alias("row_count"),
        F.sum(F.col("_copies") - 1).alias("repeated"),
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        (F.max(seq) - F.min(seq) + 1 - F.count("*")).alias("missing"),
    )
    return summary.withColumn("gap_free", (F.col("missing") == 0) & (F.col("repeated") == 0))


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _collapse(rows: DataFrame, by: list[str], cut: str | None = None) -> DataFrame:
    """Join neighbouring rows of equal ``state`` into one run; two rows with the same ``cut`` are never one run."""
    window = Window.partitionBy(*by).orderBy("run_start")
    begins = F.col("state") != F.lag("state").over(window)
    if cut is not None:
        begins = begins | (F.col(cut) == F.lag(cut).over(window))
    starts = F.coalesce(begins.cast("int"), F.lit(1))
    numbered = rows.withColumn("_run", F.sum(starts).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(
        F.first("state").alias("state"),
        F.min("run_start").alias("run_start"),
        F.max("run_end").alias("run_end"),
        F.sum("samples").alias("samples"),
    )


def _block_widths(instants: DataFrame, by: list[str], width: int, rows_per_task: int) -> list[int]:
    """Widths in microseconds: the first so narrow that no block of a series is too large, each next one so wide that
    few enough blocks meet in it, until a whole series does."""
    while True:
        counts = instants.groupBy(*by, F.expr(f"_us div {width}").alias("_block")).agg(F.count("*").alias("n"))
        densest, low, high = counts.agg(F.max("n"), F.min("_block"), F.max("_block")).first()
        if width == 1 or (densest or 0) <= rows_per_task:
            break
        width = max(1, width // (2 * -(-densest // rows_per_task)))
    widths, blocks = [width], 0 if low is None else high - low + 1
    fan = max(2, rows_per_task // 2)
    while blocks * 2 > max(4, rows_per_task):
        widths.append(widths[-1] * fan)
        blocks = blocks // fan + 2
    return widths


def runs(samples: DataFrame, by: list[str], ts: str, condition: Column, block_seconds: int = 86_400,
         rows_per_task: int = 1_000_000) -> DataFrame:
    """Longest stretches of samples over which a condition keeps its value.

    Samples of one instant are one first, on the map side: the condition holds at an instant if it holds for all of
    them. Runs are built in blocks, of ``block_seconds`` or so much less that the densest block of a series has at most
    ``rows_per_task`` instants. Only the first and the last run of a block can go on in another one, so two rows of a
    block meet in the next wider blocks, and in the end in the series.
    """
    instants = samples.select(*by, F.col(ts).alias("run_start"), F.coalesce(condition, F.lit(False)).alias("state")).groupBy(
        *by, "run_start").agg(F.bool_and("state").alias("state"), F.count("*").alias("samples"))
    instants = checkpointed(instants.withColumn("_us", _micros("run_start")))
    rows = instants.select(*by, "state", "run_start", F.col("run_start").alias("run_end"), "samples")
    out, found = [*by, "state", "run_start", "run_end", "samples"], None
    for number, width in enumerate(_block_widths(instants, by, block_seconds * 1_000_000, rows_per_task)):
        if number:
            rows = rows.withColumnRenamed("_block", "_before")
        blocked = rows.withColumn("_block", F.expr(f"unix_micros(CAST(run_start AS TIMESTAMP)) div {width}"))
        group = [*by, "_block"]
        pieces = _collapse(blocked, group, "_before" if number else None)
        outer = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy(*group)))
        pieces = checkpointed(pieces.withColumn("_outer", outer))
        inner = pieces.where(~F.col("_outer")).select(*out)
        found = inner if found is None else found.unionByName(inner)
        rows = pieces.where("_outer").select("_block", *out)
    return found.unionByName(_collapse(rows, by, "_block").select(*out))


def held_for(samples: DataFrame, by: list[str], ts: str, condition: Column, seconds: int) -> DataFrame:
    """Runs in which a condition held at least ``seconds``, and the time it began to count."""
    true_runs = runs(samples, by, ts, condition).where("state")
    held = F.unix_seconds(F.col("run_end").cast("timestamp")) - F.unix_seconds(F.col("run_start").cast("timestamp"))
    firing = F.col("run_start") + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return true_runs.withColumn("held_seconds", held).where(held >= seconds).select(
        *by, "run_start", "run_end", "samples", "held_seconds", firing.alias("firing_from")
    )
