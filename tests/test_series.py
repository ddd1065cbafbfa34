"""Running totals, gaps, runs, percentiles, histograms and alert cooldown against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators import alerts, metrics, sequence

T0 = dt.datetime(2024, 1, 1)


def test_running_totals(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, i * 2) for i in range(100)], "g string, i long, n long")
    got = sequence.running_totals(rows, "i", {"n": "total"}, by=["g"], block=7)
    sums = {"a": 0, "b": 0}
    for row in got.orderBy("i").collect():
        sums[row.g] += row.n
        assert row.total == sums[row.g]


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_gaps(spark, block):
    present = [1, 2, 2, 3, 7, 8, 20, 21, 40]
    rows = spark.createDataFrame([("t", s) for s in present], "t string, seq_id long")
    got = {(r.after_seq, r.next_seq, r.missing) for r in sequence.sequence_gaps(rows, ["t"], block=block).collect()}
    assert got == {(3, 7, 3), (8, 20, 11), (21, 40, 18)}
    summary = sequence.sequence_summary(rows, ["t"]).first()
    assert (summary.row_count, summary.repeated, summary.missing, summary.gap_free) == (9, 1, 32, False)


def brute_runs(samples):
    result = []
    for at, ok in samples:
        if result and result[-1][0] == ok:
            result[-1][2], result[-1][3] = at, result[-1][3] + 1
        else:
            result.append([ok, at, at, 1])
    return [tuple(r) for r in result]


@pytest.mark.parametrize("block", [60, 600, 86400])
def test_runs(spark, block):
    rng = random.Random(block)
    at, samples = T0, []
    for _ in range(200):
        at += dt.timedelta(seconds=rng.choice([15, 30, 200]))
        samples.append((at, rng.random() < 0.7))
    rows = spark.createDataFrame([("s", a, o) for a, o in samples], "k string, at timestamp, ok boolean")
    got = sequence.runs(rows, ["k"], "at", F.col("ok"), block_seconds=block).orderBy("run_start").collect()
    assert [(r.state, r.run_start, r.run_end, r.samples) for r in got] == brute_runs(samples)


def test_held_for(spark):
    values = [1, 9, 9, 9, 1, 9, 1]
    rows = spark.createDataFrame([("s", T0 + dt.timedelta(minutes=i), v) for i, v in enumerate(values)],
                                 "k string, at timestamp, v int")
    got = alerts.threshold_held(rows, ["k"], "at", F.col("v") > 5, 120).collect()
    assert [(r.run_start.minute, r.run_end.minute, r.firing_from.minute) for r in got] == [(1, 3, 3)]


def test_percentile_places(spark):
    rows = spark.range(1, 101).select(F.lit("k").alias("k"), F.col("id").alias("latency_ms"))
    got = metrics.latency_percentiles(rows, ["k"], digit_bits=3).first()
    assert tuple(got) == ("k", 51, 96, 100, 100, 100)


def test_approximate_percentiles(spark):
    rows = spark.range(1, 1001).select(F.lit("k").alias("k"), F.col("id").alias("latency_ms"))
    got = metrics.approximate_percentiles(rows, ["k"]).first()
    assert abs(got.p50 - 500) <= 2 and abs(got.p99 - 990) <= 2 and got.records_in_window == 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_against_sorting(spark, seed):
    rng = random.Random(seed)
    samples = [("a" if rng.random() < 0.6 else "b", int(rng.expovariate(1 / 3000))) for _ in range(700)]
    rows = spark.createDataFrame(samples, "k string, latency_ms int")
    for row in metrics.latency_percentiles(rows, ["k"], digit_bits=rng.choice([2, 5, 16])).collect():
        values = sorted(v for k, v in samples if k == row.k)
        n = len(values)
        assert (row.p50, row.p95, row.p99, row.max, row.records_in_window) == (
            values[int(n * .5)], values[int(n * .95)], values[int(n * .99)], values[-1], n)


def test_histogram_and_quantile(spark):
    values = [50, 100, 101, 700, 61000]
    rows = spark.createDataFrame([("k", v, T0) for v in values], "k string, latency_ms int, ts timestamp")
    got = {r.le: r.cumulative for r in metrics.latency_histogram(rows, ["k"]).collect()}
    assert got[100] == 2 and got[500] == 3 and got[1000] == 4 and got[60000] == 4 and got[None] == 5
    windows = metrics.histogram_quantiles(rows, ["k"], "ts", quantiles={"p40": .4, "p50": .5, "p99": .99})
    assert windows.count() == 20
    row = windows.first()
    assert row.p40 == 100.0 and row.p50 == 100 + 400 * 0.5 and row.p99 == 60000.0


def test_rates(spark):
    rows = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s)) for s in (0, 20, 400)], "k string, ts timestamp")
    got = {r.window_start_s: r.events for r in metrics.rates(rows, ["k"], "ts").collect()}
    base = 1704067200
    assert got[base] == 2 and got[base - 285] == 1 and got[base + 15] == 1 and got[base + 390] == 1
    assert base - 300 not in got and base + 405 not in got


def greedy(times, cooldown, last=None):
    fired = []
    for at in sorted(times):
        if last is None or at >= last + cooldown:
            fired.append(at)
            last = at
    return fired


def firings(spark, events, fan=32, levels=2, rows_per_task=1_000_000):
    """``events``: rule, minute, event id, cooldown minutes, minute of the last firing or None."""
    rows = spark.createDataFrame(
        [(r, T0 + dt.timedelta(minutes=m), e, c, None if f is None else T0 + dt.timedelta(minutes=f))
         for r, m, e, c, f in events],
        "rule_id string, at timestamp, event_id long, cooldown_minutes int, last_fired_at timestamp")
    return sorted((r.rule_id, r.event_id) for r in alerts.cooldown_firings(rows, fan, levels, rows_per_task).collect())


def test_cooldown_example(spark):
    minutes = [0, 5, 15, 16, 31]
    events = [("r", m, m, 15, None) for m in minutes] + [("s", m, m, 15, -5) for m in minutes] + [
        ("z", m, m, 0, None) for m in minutes] + [("d", 3, 8, 15, None), ("d", 3, 7, 15, None)]
    assert firings(spark, events) == [("d", 7), ("r", 0), ("r", 15), ("r", 31), ("s", 15), ("s", 31)] + [
        ("z", m) for m in minutes]


@pytest.mark.parametrize("seed,fan,levels", [(1, 2, 3), (2, 3, 2), (3, 2, 1), (4, 32, 2), (5, None, None)])
def test_cooldown_against_the_plain_loop(spark, seed, fan, levels):
    rng = random.Random(seed)
    events, expected = [], []
    for rule in range(4):
        cooldown = rng.choice([3, 7, 15])
        times = sorted({rng.randrange(1500) for _ in range(rng.choice([20, 300, 900]))})
        times = [m for m in times if not 400 < m < 700]
        last = rng.choice([None, 30])
        events += [(str(rule), m, m, cooldown, last) for m in times]
        expected += [(str(rule), m) for m in greedy(times, cooldown, last)]
    assert firings(spark, events, fan, levels, rows_per_task=60) == sorted(expected)


def test_matching_rules(spark):
    events = spark.createDataFrame(
        [(1, "error_rate", "warning", "o1", T0), (2, "error_rate", "info", None, T0), (3, "custom", "odd", "o2", T0)],
        "event_id long, alert_type string, severity string, org_id string, at timestamp")
    rules = spark.createDataFrame(
        [("a", "error_rate", "warning", "c1", 5, True, "o1"), ("b", "error_rate", None, "c1", 5, True, "o2"),
         ("c", "error_rate", "info", "off", 5, True, "o1"), ("d", "error_rate", "info", "c1", 5, False, "o1"),
         ("e", "custom", "info", "c1", 5, True, "o2"), ("f", "custom", "critical", "c1", 5, True, "o2")],
        "rule_id string, condition_type string, severity_filter string, channel_id string, cooldown_minutes int, "
        "is_enabled boolean, org_id string").withColumn("last_fired_at", F.lit(None).cast("timestamp"))
    channels = spark.createDataFrame([("c1", True), ("off", False)], "channel_id string, is_active boolean")
    got = sorted((r.rule_id, r.event_id) for r in alerts.matching_rules(events, rules, channels).collect())
    assert got == [("a", 1), ("b", 2), ("e", 3)]


def test_samples_of_one_instant_count_once(spark):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:10", 1), ("a", "2024-01-01 00:00:10", 9), ("a", "2024-01-01 00:00:20", 9)]
    df = spark.createDataFrame(rows * 2, "s string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    for parts in (1, 3):
        found = sequence.runs(df.repartition(parts), ["s"], "ts", F.col("v") > 5).orderBy("run_start").collect()
        assert [(r.state, r.samples) for r in found] == [(False, 6), (True, 2)]


@pytest.mark.parametrize("rows_per_task", [8, 50])
def test_runs_of_a_dense_day(spark, rows_per_task):
    rng = random.Random(rows_per_task)
    at, samples = T0, []
    for i in range(600):
        at += dt.timedelta(microseconds=rng.choice([1, 3, 500])) if 100 < i < 400 else dt.timedelta(hours=rng.choice([1, 30]))
        samples.append((at, rng.random() < 0.8))
    rows = spark.createDataFrame([("s", a, o) for a, o in samples], "k string, at timestamp, ok boolean")
    got = sequence.runs(rows, ["k"], "at", F.col("ok"), rows_per_task=rows_per_task).orderBy("run_start").collect()
    assert [(r.state, r.run_start, r.run_end, r.samples) for r in got] == brute_runs(samples)


@pytest.mark.parametrize("rows_per_task", [8, 50])
def test_blocks_of_runs_are_bounded(spark, rows_per_task):
    rows = spark.range(5000).select(F.lit("s").alias("k"), (F.col("id") * 7).alias("_us"))
    widths = sequence._block_widths(rows, ["k"], 86_400_000_000, rows_per_task)
    sizes = rows.groupBy("k", F.expr(f"_us div {widths[0]}")).count().agg(F.max("count")).first()[0]
    assert sizes <= rows_per_task
    for narrow, wide in zip(widths, widths[1:]):
        assert wide // narrow * 2 <= max(4, rows_per_task)
    assert 2 * (5000 * 7 // widths[-1] + 1) <= max(4, rows_per_task)


def test_no_samples_have_no_runs(spark):
    rows = spark.createDataFrame([], "k string, at timestamp, ok boolean")
    assert sequence.runs(rows, ["k"], "at", F.col("ok")).count() == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_windows_of_panes(spark, block):
    rng = random.Random(block)
    panes = {(k, p): rng.randrange(1, 9) for k in "ab" for p in rng.sample(range(-40, 90), 40)}
    rows = spark.createDataFrame([(k, p, n) for (k, p), n in panes.items()], "k string, _pane long, events long")
    got = metrics.windows_of_panes(rows, ["k"], ["events"], 5, block).collect()
    expected = {}
    for (k, p), n in panes.items():
        for first in range(p - 4, p + 1):
            expected[k, first] = expected.get((k, first), 0) + n
    assert len(got) == len(expected) and {(r.k, r["_first"]): r.events for r in got} == expected
