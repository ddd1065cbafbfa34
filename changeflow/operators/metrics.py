"""Latency percentiles, histograms, rates, backlog and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.times import minute_label
from changeflow.session import checkpointed, same_join

# Upper bounds of the latency buckets in milliseconds.
LATENCY_BOUNDS = [100, 500, 1000, 2000, 5000, 10000, 15000, 20000, 25000, 30000, 60000]
# The reported quantiles.
QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
SLA_MS = 30_000
HIGH_LATENCY_MS = 25_000


# Bits of a value that one round of the selection tells apart.
DIGIT_BITS = 16


def ordered_bits(value: Column, kind: T.DataType) -> Column:
    """A whole number of 64 bits in the order of the values: NaN comes last, and -0.0 is 0.0."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        number = F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(0.0)
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number).cast("bigint")
        return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    raise ValueError(f"no order of bits for {kind.simpleString()}")


def _digit(shift: int) -> Column:
    return F.shiftright("_key", shift) if shift else F.col("_key")


def latency_percentiles(samples: DataFrame, by: list[str], value: str = "latency_ms",
                        quantiles: dict[str, float] | None = None, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Exact percentiles: the sample at zero-based place ``int(n * q)`` of the sorted samples.

    Samples are counted per distinct value first. The wanted places are then selected by the bits of the values, from
    the highest that differ: counts of one digit's bins show which bin holds a place, and only such bins are looked into
    in the next round. So a bin is at most 2 ** ``digit_bits`` rows, whatever the values are. Null values don't count; null
    groups do.
    """
    quantiles = quantiles or QUANTILES
    known = samples.where(F.col(value).isNotNull())
    kind = samples.schema[value].dataType
    ends = known.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    low, high = ends.select(ordered_bits(F.col("low"), kind), ordered_bits(F.col("high"), kind)).first()
    bits = 0 if low is None else (low ^ high if (low < 0) == (high < 0) else (1 << 64) - 1).bit_length()
    shifts = list(range(0, max(bits, 1), digit_bits))[::-1]
    counts = known.groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_n")).withColumn(
        "_key", ordered_bits(F.col("_value"), kind))
    if len(shifts) > 1:
        # Read again in each round.
        counts = checkpointed(counts)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("records_in_window"), F.max("_value").alias("max"))
    wanted = None
    for round_number, shift in enumerate(shifts):
        # Bins of a digit inside the bin of the digits before, which is the whole group in the first round.
        outer = [*by, "_bin"] if round_number else by
        rows = counts
        if round_number:
            live = wanted.select(*outer).distinct()
            rows = same_join(counts.withColumn("_bin", _digit(shifts[round_number - 1])), live, outer, "left_semi")
        cells = rows.groupBy(*outer, _digit(shift).alias("_cell")).agg(F.sum("_n").alias("_n"), F.min("_value").alias("_value"))
        upto = F.sum("_n").over(Window.partitionBy(*outer).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("_upto", upto)
        if not round_number:
            total = F.sum("_n").over(Window.partitionBy(*by))
            places = F.array(*[F.struct(F.lit(n).alias("_name"), F.floor(F.col("_total").cast("double") * F.lit(float(q))).alias("_at"))
                               for n, q in quantiles.items()])
            found = cells.withColumn("_total", total).select("*", F.inline(places))
        else:
            found = same_join(cells, wanted.drop("_value"), outer)
        found = found.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
        wanted = found.select(*by, "_name", (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_at"),
                              F.col("_cell").alias("_bin"), "_value")
        if round_number < len(shifts) - 1:
            wanted = checkpointed(wanted)
    # One row for each group and quantile; the value of the last, whole key is the only one in its bin.
    values = wanted.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in quantiles])
    return same_join(values, totals, by).select(*by, *quantiles, "max", "records_in_window")


def approximate_percentiles(samples: DataFrame, by: list[str], value: str = "latency_ms",
                            quantiles: dict[str, float] | None = None, accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch of the same figures, for series where the exact place does not matter."""
    quantiles = quantiles or QUANTILES
    return samples.groupBy(*by).agg(
        *[F.percentile_approx(value, q, accuracy).alias(name) for name, q in quantiles.items()],
        F.max(value).alias("max"),
        F.count(value).alias("records_in_window"),
    )


def bucket_counts(value: str, bounds: list[int] = LATENCY_BOUNDS) -> list[Column]:
    """Cumulative counts ``le_<bound>`` and ``le_inf`` as plain aggregates."""
    return [F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds] + [F.count(value).alias("le_inf")]


def latency_histogram(samples: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """One row per group and bucket: upper bound (null for the last, open one) and cumulative count."""
    wide = samples.groupBy(*by).agg(*bucket_counts(value))
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"le_{b}").alias("cumulative")) for b in LATENCY_BOUNDS]
    cells.append(F.struct(F.lit(None).cast("int").alias("le"), F.col("le_inf").alias("cumulative")))
    return wide.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.le", "_c.cumulative")


def bucket_quantile(q: float, bounds: list[int] = LATENCY_BOUNDS) -> Column:
    """Quantile from cumulative bucket columns, linear inside a bucket, capped at the last bound."""
    rank = F.lit(float(q)) * F.col("le_inf")
    result = F.when(F.col("le_inf") == 0, F.lit(None).cast("double"))
    low, below = F.lit(0), F.lit(0)
    for bound in bounds:
        upto = F.col(f"le_{bound}")
        share = (rank - below) / F.nullif(upto - below, F.lit(0))
        result = result.when(upto >= rank, low + (F.lit(bound) - low) * share)
        low, below = F.lit(bound), upto
    return result.otherwise(F.lit(float(bounds[-1])))


def window_runs(panes: DataFrame, by: list[str], sums: list[str], steps: int, block: int = 4096) -> DataFrame:
    """(by, _first, _last, sums): sums over ``steps`` panes, equal for all windows from ``_first`` to ``_last``.

    ``panes``: by, ``_pane`` (a whole number, once in a series) and the columns ``sums``. A pane adds its counts where its
    first window begins and takes them back after its last, so a pane is two change points and one running sum gives all
    windows. A series is summed in blocks of change points, and blocks by one row each. Windows without a pane are left out.
    """
    counted = [*sums, "_panes"]
    opens = F.struct((F.col("_pane") - (steps - 1)).alias("_first"), *sums, F.lit(1).alias("_panes"))
    closes = F.struct((F.col("_pane") + 1).alias("_first"), *[(-F.col(c)).alias(c) for c in sums], F.lit(-1).alias("_panes"))
    points = panes.where(F.col("_pane").isNotNull()).select(*by, F.inline(F.array(opens, closes)))
    points = points.groupBy(*by, "_first").agg(*[F.sum(c).alias(c) for c in counted])
    points = points.withColumn("_block", F.floor(F.col("_first") / block))
    blocks = points.groupBy(*by, "_block").agg(*[F.sum(c).alias(c) for c in counted], F.min("_first").alias("_begin"))
    series = Window.partitionBy(*by).orderBy("_block")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select(*by, "_block", F.lead("_begin").over(series).alias("_after"),
                           *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_shift_{c}") for c in counted])
    inside = Window.partitionBy(*by, "_block").orderBy("_first")
    running = points.select(*by, "_block", "_first", F.lead("_first").over(inside).alias("_next"),
                            *[F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in counted])
    joined = same_join(running, shifts, [*by, "_block"]).where(F.col("_panes") + F.col("_shift__panes") > 0)
    return joined.select(*by, "_first", (F.coalesce("_next", "_after") - 1).alias("_last"),
                         *[(F.col(c) + F.col(f"_shift_{c}")).alias(c) for c in sums])


def windows_of_runs(runs: DataFrame) -> DataFrame:
    """A row for each window, ``_first`` its first pane, from rows for stretches of equal windows."""
    rest = [c for c in runs.columns if c not in ("_first", "_last")]
    return runs.select(F.explode(F.sequence("_first", "_last")).alias("_first"), *rest)


def windows_of_panes(panes: DataFrame, by: list[str], sums: list[str], steps: int, block: int = 4096) -> DataFrame:
    """(by, _first, sums): sums over the ``steps`` panes from ``_first`` on, for each window that holds a pane."""
    return windows_of_runs(window_runs(panes, by, sums, steps, block)).select(*by, "_first", *sums)


def _pane_runs(samples: DataFrame, by: list[str], ts: str, aggregates: list[Column], sums: list[str],
               length: int, slide: int) -> DataFrame:
    """Rows are aggregated once per pane of ``slide`` seconds; ``aggregates`` are counts or sums, ``sums`` their names."""
    pane = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slide)
    panes = samples.groupBy(*by, pane.alias("_pane")).agg(*aggregates)
    return window_runs(panes, by, sums, length // slide)


def _with_start(runs: DataFrame, by: list[str], columns: list[str], slide: int) -> DataFrame:
    return windows_of_runs(runs).select(*by, (F.col("_first") * slide).alias("window_start_s"), *columns)


def sliding(samples: DataFrame, by: list[str], ts: str, aggregates: list[Column], sums: list[str],
            length: int = 300, slide: int = 15) -> DataFrame:
    """Sliding windows from tumbling panes; ``aggregates`` must be counts or sums, ``sums`` their names."""
    return _with_start(_pane_runs(samples, by, ts, aggregates, sums, length, slide), by, sums, slide)


def histogram_quantiles(samples: DataFrame, by: list[str], ts: str, value: str = "latency_ms",
                        quantiles: dict[str, float] | None = None, length: int = 300, slide: int = 15) -> DataFrame:
    """Interpolated quantiles over sliding windows, computed once for a stretch of equal windows."""
    names = [f"le_{b}" for b in LATENCY_BOUNDS] + ["le_inf"]
    runs = _pane_runs(samples, by, ts, bucket_counts(value), names, length, slide)
    quantiles = quantiles or QUANTILES
    found = runs.select(*by, "_first", "_last", *[bucket_quantile(q).alias(n) for n, q in quantiles.items()])
    return _with_start(found, by, list(quantiles), slide)


def _per_second(runs: DataFrame, by: list[str], length: int, slide: int) -> DataFrame:
    rate = F.col("events") / F.lit(float(length))
    return _with_start(runs.withColumn("per_second", rate), by, ["events", "per_second"], slide)


def rates(events: DataFrame, by: list[str], ts: str, length: int = 300, slide: int = 15) -> DataFrame:
    """Events per second over sliding windows; windows without events give no row."""
    return _per_second(_pane_runs(events, by, ts, [F.count("*").alias("events")], ["events"], length, slide), by, length, slide)


def rates_of_panes(panes: DataFrame, by: list[str], start: str, length: int = 300, slide: int = 15) -> DataFrame:
    """The same from stored counts of tumbling panes: by, ``start`` (a timestamp) and events."""
    numbered = panes.withColumn("_pane", F.floor(F.unix_seconds(start) / slide)).select(*by, "_pane", "events")
    return _per_second(window_runs(numbered, by, ["events"], length // slide), by, length, slide)


def message_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("messages"))


def sla_level(p95: Column, threshold: int = SLA_MS) -> Column:
    return F.when(p95 > threshold, F.lit("breach")).otherwise(F.lit("warning"))


def backlog(log: DataFrame, by: list[str]) -> DataFrame:
    """All rows and unconsumed rows per change log."""
    return log.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(~F.col("is_consumed")).alias("pending"))


def consumer_lag(log: DataFrame, state: DataFrame, by: list[str], seq: str = "seq_id") -> DataFrame:
    """Highest logged sequence less the last applied one; both sides are one row per group."""
    marks = log.groupBy(*by).agg(F.max(seq).alias("high_watermark"))
    applied = state.groupBy(*by).agg(F.max("last_seq").alias("current_offset"))
    current = F.coalesce(F.col("current_offset"), F.lit(0))
    return same_join(marks, applied, by, "left").select(
        *by, "high_watermark", current.alias("current_offset"), (F.col("high_watermark") - current).alias("lag")
    )


def dashboard_kpis(streams: DataFrame) -> DataFrame:
    """Stream counts, records and mean latency over streams that report one."""
    latency = F.col("avg_latency_ms")
    reporting = F.greatest(F.count_if(latency != 0), F.lit(1))
    total = F.sum(F.coalesce(latency, F.lit(0)))
    return streams.agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count("*").alias("streams"),
        F.sum("records_processed_total").alias("records"),
        F.floor(total / reporting + 0.5).alias("avg_latency_ms"),
    )


def dashboard_alerts(streams: DataFrame) -> DataFrame:
    """Streams in error with a message, and streams with high latency; one row each."""
    error = F.when(
        (F.col("status") == "error") & (F.coalesce("error_message", F.lit("")) != ""),
        F.struct(F.lit("error").alias("level"), F.col("error_message").alias("text")),
    )
    slow = F.when(
        F.col("avg_latency_ms") > HIGH_LATENCY_MS,
        F.struct(F.lit("warn").alias("level"),
                 F.concat(F.lit("High latency: "), F.col("avg_latency_ms").cast("string"), F.lit("ms")).alias("text")),
    )
    alerts = F.explode(F.array_compact(F.array(error, slow))).alias("_a")
    return streams.select("config_id", alerts).select("config_id", "_a.level", "_a.text")


def throughput_matrix(metrics: DataFrame, targets: list[str], newest: int = 30) -> DataFrame:
    """Records by minute label and target from the newest rows; the last row of a cell counts."""
    rows = metrics.orderBy(F.desc("window_end"), F.desc("config_id"), F.desc("target_type")).limit(newest)
    cells = rows.withColumn("label", minute_label(F.col("window_end")))
    return cells.groupBy("label").pivot("target_type", targets).agg(
        F.max_by("records_in_window", F.struct("window_end", "config_id"))
    )
