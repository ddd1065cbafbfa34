"""A null group or key part is a group or key like any other, also where a frame meets its own aggregate."""

import pytest
from pyspark.sql import functions as F

from changeflow.operators import apply, metrics, sequence
from changeflow.session import same_join

ROW = "a string, b string, v string, _cdc_op string, _cdc_ts long, _cdc_seq long"


def test_same_join(spark):
    left = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "k string, l int")
    right = spark.createDataFrame([(None, 20), ("x", 10), ("z", 40)], "k string, r int")
    whole = {tuple(r) for r in same_join(left, right, ["k"], "full_outer").collect()}
    assert whole == {("x", 1, 10), (None, 2, 20), ("y", 3, None), ("z", None, 40)}
    assert {tuple(r) for r in same_join(left, right, ["k"]).collect()} == {("x", 1, 10), (None, 2, 20)}
    assert [tuple(r) for r in same_join(left, right, ["k"], "left_anti").collect()] == [("y", 3)]
    assert same_join(left, right, ["k"], "left_semi").columns == ["k", "l"]


def test_running_totals_and_gaps(spark):
    rows = spark.createDataFrame([(None, i, 1) for i in range(10)] + [("a", 2, 5)], "g string, i long, n long")
    got = {(r.g, r.i): r.total for r in sequence.running_totals(rows, "i", {"n": "total"}, ["g"], block=3).collect()}
    assert got[None, 9] == 10 and got["a", 2] == 5 and len(got) == 11
    log = spark.createDataFrame([(None, 1), (None, 5), ("a", 1), ("a", 2)], "t string, seq_id long")
    assert [tuple(r) for r in sequence.sequence_gaps(log, ["t"], block=2).collect()] == [(None, 1, 5, 3)]


def test_percentiles_and_lag(spark):
    rows = spark.createDataFrame([(None, v) for v in range(100)] + [("a", 7)], "k string, latency_ms int")
    got = {r.k: r.p50 for r in metrics.latency_percentiles(rows, ["k"]).collect()}
    assert got == {None: 50, "a": 7}
    log = spark.createDataFrame([(None, 9), ("a", 4)], "t string, seq_id long")
    state = spark.createDataFrame([(None, 9)], "t string, last_seq long")
    assert {(r.t, r.lag) for r in metrics.consumer_lag(log, state, ["t"]).collect()} == {(None, 0), ("a", 4)}


def test_reconcile(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), (None, None)], "g string, v int")
    got = {r.g: (r.source_rows, r.target_rows, r.matches) for r in apply.reconcile(rows, rows, ["g", "v"], ["g"]).collect()}
    assert got == {None: (2, 2, True), "a": (1, 1, True)}


@pytest.mark.parametrize("guard", [True, False])
def test_a_replay_with_a_null_key_part_is_harmless(spark, guard):
    target = spark.createDataFrame([("k", None, "old", "I", 1, 1), ("k", "x", "kept", "I", 1, 1)], ROW)
    changes = spark.createDataFrame([("k", None, "new", "U", 2, 2), (None, None, "n", "I", 3, 3)],
                                    "a string, b string, v string, op string, ts_ms long, seq long")
    for _ in range(3):
        target = apply.merge_replace(target, changes, ["a", "b"], guard=guard)
        assert {(r.a, r.b, r.v) for r in target.collect()} == {("k", None, "new"), ("k", "x", "kept"), (None, None, "n")}
        assert target.count() == 3
    gone = changes.withColumn("op", F.lit("D"))
    assert [r.v for r in apply.survivors_and_upserts(target, gone, ["a", "b"]).collect()] == ["kept"]
