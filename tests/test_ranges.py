"""Work on sampled ranges: ranks, nearest values, dense cooldowns, selection by bits, windows by change points."""

import datetime as dt
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from changeflow.operators import alerts, metrics, ranges

T0 = dt.datetime(2024, 1, 1)


def test_ranks_follow_the_order(spark):
    values = random.Random(1).sample(range(10_000), 900)
    rows = spark.createDataFrame([(v, "x") for v in values] + [(None, "y")], "v long, t string").repartition(5)
    got = ranges.ranked(rows, ["v"], start=5, rows_per_range=50).orderBy("rank")
    assert got.columns == ["v", "t", "rank"]
    assert [(r.v, r["rank"]) for r in got.collect()] == [(None, 5)] + [(v, 6 + i) for i, v in enumerate(sorted(values))]
    assert ranges.ranked(rows.limit(0), ["v"]).count() == 0


def test_ranges_are_bounded(spark):
    rows = spark.range(20_000).select(F.lit("one group").alias("g"), F.col("id").alias("v")).repartition(7)
    sizes = [r["count"] for r in ranges.placed(rows, ["g", "v"], 500).groupBy("_range").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 500


@pytest.mark.parametrize("after", [True, False])
@pytest.mark.parametrize("size", [4, 1000])
def test_nearest(spark, after, size):
    rng = random.Random(size)
    data = [(rng.choice(["a", "b", None]), i, i * 10 if rng.random() < 0.2 else None) for i in range(200)]
    found = ranges.placed(spark.createDataFrame(data, "g string, i long, v long"), ["g", "i"], size)
    got = {r.i: r.near for r in ranges.nearest(found, ["g"], F.col("v"), "near", after).collect()}
    for g, i, _ in data:
        others = [v for h, j, v in data if h == g and v is not None and (j > i if after else j < i)]
        assert got[i] == ((min if after else max)(others) if others else None)


def firings(spark, instants, cooldown, rows_per_task, last=None):
    rows = spark.createDataFrame(
        [(r, T0 + dt.timedelta(microseconds=m), e, cooldown, last) for r, m, e in instants],
        "rule_id string, at timestamp, event_id long, cooldown_minutes int, last_fired_at timestamp")
    return sorted((r.rule_id, r.event_id) for r in alerts.cooldown_firings(rows, rows_per_task=rows_per_task).collect())


def greedy(times, cooldown):
    fired = []
    for at in sorted(times):
        if not fired or at >= fired[-1] + cooldown:
            fired.append(at)
    return fired


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dense_rules_beside_sparse_ones(spark, seed):
    rng = random.Random(seed)
    minute, instants, expected = 60_000_000, [], []
    for rule, (n, span) in enumerate([(600, 40), (600, 4), (30, 400), (250, 900)]):
        times = sorted({rng.randrange(span * minute) for _ in range(n)} | {0, 7 * minute})
        times += [t + 30 * 60 * minute for t in times[: n // 2]]
        instants += [(str(rule), t, t) for t in times]
        expected += [(str(rule), t) for t in greedy(times, 7 * minute)]
    assert firings(spark, instants, 7, 40) == sorted(expected)


def test_one_cooldown_of_a_hundred_tasks(spark, monkeypatch):
    """No range of the order holds more rows than a task may, though one cooldown has a hundred times as many."""
    sizes = []

    def watched(rows, order, rows_per_range=ranges.ROWS_PER_RANGE, count=None):
        found = ranges.placed(rows, order, rows_per_range, count)
        sizes.append(found.groupBy("_range").count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(alerts, "placed", watched)
    times = [t * 50_000 for t in range(20_000)]
    instants = [("r", t, t) for t in times] + [("r", t, t) for t in (15 * 60_000_000, 40 * 60_000_000)]
    got = firings(spark, instants, 15, 200)
    assert [e for _, e in got] == greedy([t for _, t, _ in instants], 15 * 60_000_000)
    assert sizes and max(s or 0 for s in sizes) <= 200


def test_doubling_needs_few_rounds(spark, monkeypatch):
    rounds = []
    real = alerts._twice
    monkeypatch.setattr(alerts, "_twice", lambda jumps, n: rounds.append(1) or real(jumps, n))
    second = 1_000_000
    instants = [("r", t * second, t) for t in range(0, 60 * 33, 5)]
    got = firings(spark, instants, 1, 10)
    assert [e for _, e in got] == list(range(0, 60 * 33, 60))
    assert len(rounds) <= math.ceil(math.log2(33)) + 1


DOUBLES = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 3.0, 3.0000000000000004, 2.9999999999999996]


def test_bits_are_in_order(spark):
    rows = spark.createDataFrame([(v,) for v in DOUBLES], "v double")
    got = [r.v for r in rows.withColumn("b", metrics.ordered_bits(F.col("v"), rows.schema["v"].dataType)).orderBy("b").collect()]
    assert got == sorted(DOUBLES)
    dated = spark.createDataFrame([(dt.date(1960, 1, 1), T0, Decimal(5)), (dt.date(2024, 1, 2), dt.datetime(1950, 1, 1), Decimal(-5))], "d date, t timestamp, n decimal(10,2)")
    for name, first in (("d", dt.date(1960, 1, 1)), ("t", dt.datetime(1950, 1, 1)), ("n", -5)):
        assert dated.orderBy(metrics.ordered_bits(F.col(name), dated.schema[name].dataType)).first()[name] == first
    with pytest.raises(ValueError):
        metrics.ordered_bits(F.col("s"), spark.createDataFrame([], "s string").schema["s"].dataType)


def places(values, quantiles):
    values = sorted(values)
    return [values[int(len(values) * q)] for q in quantiles]


@pytest.mark.parametrize("digit_bits", [7, 16])
def test_percentiles_of_doubles_inside_one_whole_number(spark, digit_bits):
    rng = random.Random(digit_bits)
    samples = [(rng.choice(["a", "a", None]), 5 + rng.random()) for _ in range(3000)]
    samples += [("odd", v) for v in DOUBLES] + [("a", None), ("none", None)]
    rows = spark.createDataFrame(samples, "g string, v double").repartition(3)
    got = {r.g: r for r in metrics.latency_percentiles(rows, ["g"], "v", digit_bits=digit_bits).collect()}
    assert set(got) == {"a", None, "odd"}
    for g, row in got.items():
        values = [v for h, v in samples if h == g and v is not None]
        assert [row.p50, row.p95, row.p99] == places(values, [0.5, 0.95, 0.99])
        assert row.max == max(values) and row.records_in_window == len(values)


def test_many_distinct_values_in_small_bins(spark, monkeypatch):
    """A million doubles in one whole number: every round looks into bins of one digit only."""
    rows = spark.range(1_000_000).select(F.lit(None).cast("string").alias("g"), ((F.col("id") * 7919 % 1_000_003) / 1_000_003 + 8).alias("v"))
    row = metrics.latency_percentiles(rows, ["g"], "v").first()
    values = sorted(i * 7919 % 1_000_003 / 1_000_003 + 8 for i in range(1_000_000))
    assert [row.p50, row.p95, row.p99] == [values[int(1_000_000 * q)] for q in (0.5, 0.95, 0.99)]
    assert struct.pack("d", row.max) == struct.pack("d", values[-1])


def test_empty_percentiles(spark):
    assert metrics.latency_percentiles(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], "v").count() == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_stretches_of_equal_windows(spark, block):
    rng = random.Random(block)
    panes = {(k, p): (rng.randrange(0, 9), rng.randrange(3)) for k in ("a", None) for p in rng.sample(range(-40, 90), 30)}
    rows = spark.createDataFrame([(k, p, *n) for (k, p), n in panes.items()] + [("a", None, 1, 1)], "k string, _pane long, x long, y long")
    stretches = metrics.window_runs(rows, ["k"], ["x", "y"], 5, block)
    got = {(r.k, r["_first"]): (r.x, r.y) for r in metrics.windows_of_runs(stretches).collect()}
    expected = {}
    for (k, p), (x, y) in panes.items():
        for first in range(p - 4, p + 1):
            a, b = expected.get((k, first), (0, 0))
            expected[k, first] = a + x, b + y
    assert got == expected
    assert stretches.count() <= 2 * len(panes)
