import random

import pytest
from pyspark.sql import functions as F

from changeflow import session
from changeflow.operators import apply, status

DDL = "id int, v string, op string, ts_ms long, seq long"


def frame(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def change(seq, op, key, value=None):
    return (key, value, op, seq * 10, seq)


def state(df):
    return {r.id: (r.v, r._cdc_seq) for r in df.collect()}


def test_worked_example(spark):
    target = apply.with_meta(frame(spark, [change(1, "I", 1, "a"), change(2, "I", 2, "b"), change(9, "I", 3, "c")]))
    batch = frame(spark, [change(5, "U", 1, "a2"), change(6, "U", 1, "a3"), change(7, "D", 2), change(8, "I", 4, "d"),
                          change(9, "D", 4), change(10, "I", 5, "e"), change(4, "U", 3, "old")])
    merged = apply.merge_replace(target, batch, ["id"])
    assert state(merged) == {1: ("a3", 6), 3: ("c", 9), 5: ("e", 10)}
    unguarded = apply.merge_replace(target, batch, ["id"], guard=False)
    assert state(unguarded)[3] == ("old", 4)
    first = apply.merge_replace(target, batch, ["id"], order="deletes_first", guard=False)
    assert 4 in state(first)


def random_changes(seed, n=200, keys=12):
    rng = random.Random(seed)
    return [change(s, rng.choice("IUUD"), rng.randrange(keys), rng.choice("abc")) for s in range(1, n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_compose_and_replay_is_harmless(spark, seed):
    changes = random_changes(seed)
    random.Random(seed).shuffle(changes)
    one, two = changes[:90], changes[90:]
    empty = apply.with_meta(frame(spark, []))

    def step(target, batch):
        return apply.merge_replace(target, frame(spark, batch), ["id"], keep_deleted=True)

    both = step(step(empty, one), two)
    expected = {}
    for key, value, op, _, seq in sorted(changes, key=lambda c: c[4]):
        expected[key] = None if op == "D" else (value, seq)
    expected = {k: v for k, v in expected.items() if v}
    live = F.col("_cdc_op") != "D"
    assert state(both.where(live)) == expected
    assert state(step(both, one).where(live)) == expected
    assert state(step(empty, changes).where(live)) == expected
    assert state(apply.with_meta(apply.current_state(frame(spark, changes), ["id"]))) == expected


def test_merge_with_different_columns(spark):
    target = apply.with_meta(spark.createDataFrame([(1, "a", 7, "I", 0, 1)], "id int, v string, w int, op string, ts_ms long, seq long"))
    batch = frame(spark, [change(2, "U", 1, "b"), change(3, "I", None, "n")])
    rows = {r.id: (r.v, r.w) for r in apply.merge_replace(target, batch, ["id"]).collect()}
    assert rows == {1: ("b", None), None: ("n", None)}


def test_hot_key_stays_small_before_the_shuffle(spark):
    """One key with most rows: the plan combines before the exchange and never sorts or collects the group."""
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("id"), F.lit("v").alias("v"), F.lit("U").alias("op"),
        F.col("id").alias("ts_ms"), F.col("id").alias("seq"))
    result = apply.latest_change(rows, ["id"])
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
    assert result.where("id = 1").first().seq == 19999


def patch_reference(changes):
    documents = {}
    for key, after, op, _, seq in sorted(changes, key=lambda c: c[4]):
        if op == "D":
            documents.pop(key, None)
        elif after is not None:
            documents.setdefault(key, {}).update(after)
    return documents


PATCH_DDL = "id int, after map<string,string>, op string, ts_ms long, seq long"


def documents(spark, entries):
    return {r.id: r.document for r in apply.documents_from_entries(entries, ["id"]).collect()}


def test_patch_worked_example(spark):
    rows = [(1, {"a": "1", "b": "2"}, "I", 0, 1), (1, {"b": "3"}, "U", 0, 2), (1, {"a": None}, "U", 0, 6),
            (2, {"a": "9", "b": "9"}, "I", 0, 3), (2, None, "D", 0, 4), (2, {"b": "5"}, "U", 0, 5), (3, {}, "I", 0, 7),
            (4, None, "I", 0, 8)]
    folded = apply.fold_entries(apply.patch_entries(frame(spark, rows, PATCH_DDL), ["id"]), ["id"])
    assert documents(spark, folded) == {1: {"a": None, "b": "3"}, 2: {"b": "5"}, 3: {}}


@pytest.mark.parametrize("seed", [4, 5])
def test_patch_is_independent_of_batches_and_order(spark, seed):
    rng = random.Random(seed)
    changes = [(rng.randrange(8), None if op == "D" else {rng.choice("abc"): rng.choice("xyz")}, op, 0, s)
               for s in range(1, 150) for op in [rng.choice("IUUUD")]]
    expected = patch_reference(changes)
    rng.shuffle(changes)
    entries = apply.patch_entries(frame(spark, [], PATCH_DDL), ["id"])
    for i in (0, 50, 100, 0):
        entries = apply.merge_patch(entries, frame(spark, changes[i:i + 50], PATCH_DDL), ["id"])
    assert documents(spark, entries) == expected


def test_counts(spark):
    rows = frame(spark, [change(1, "I", 1, "a"), change(2, "U", 1), change(3, "D", 1), change(4, "X", 1, "a")])
    got = apply.op_counts(rows.withColumn("t", F.lit("t")), ["t"], after="v").first()
    assert tuple(got) == ("t", 1, 0, 1, 2, 2)


def test_reconcile(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 1)], "g string, v int")
    right = spark.createDataFrame([("a", 2), ("a", 1), ("b", 4), ("d", 1)], "g string, v int")
    got = {r.g: (r.source_rows, r.target_rows, r.matches) for r in apply.reconcile(left, right, ["g", "v"], ["g"]).collect()}
    assert got == {"a": (2, 2, True), "b": (1, 1, False), "c": (1, 0, False), "d": (0, 1, False)}


def test_control_commands(spark):
    ddl = "command_id int, config_id string, command string, issued_at timestamp"
    rows = spark.sql("""
      select * from values (1,'a','pause',timestamp'2024-01-01 00:00:00'), (2,'a','resume',timestamp'2024-01-01 00:01:00'),
        (3,'b','pause',timestamp'2024-01-01 00:00:00'), (4,'b','reload',timestamp'2024-01-01 00:02:00'),
        (5,'c','pause',timestamp'2024-01-01 00:00:00'), (6,'c','restart',timestamp'2024-01-01 00:02:00')
        as t(command_id, config_id, command, issued_at)""").to(spark.createDataFrame([], ddl).schema)
    assert [r.config_id for r in status.paused_configs(rows).collect()] == ["b"]
    log = spark.createDataFrame([("a",), ("b",), ("c",)], "config_id string")
    assert sorted(r.config_id for r in status.without_paused(log, rows).collect()) == ["a", "c"]
    state = spark.sql("""select * from values ('a', 5L, timestamp'2024-01-01'), ('c', 7L, timestamp'2024-01-01'),
      ('c', 6L, timestamp'2023-01-01') as t(config_id, last_seq, updated_at)""")
    assert {tuple(r) for r in status.start_positions(state, rows).collect()} == {("a", 5), ("c", 0)}


def test_reconcile_sees_cancelling_and_moved_values(spark):
    def frame(rows):
        return spark.createDataFrame([("g", *r) for r in rows], "g string, a string, b string")

    def matches(left, right):
        return apply.reconcile(frame(left), frame(right), ["a", "b"], ["g"]).first().matches

    assert not matches([("a", "x"), ("a", "x")], [("b", "x"), ("b", "x")])
    assert not matches([("a", None)], [(None, "a")])
    assert matches([("a", None), ("b", "c")], [("b", "c"), ("a", None)])


def test_replayed_batch_leaves_state(spark):
    state = spark.createDataFrame([("c", "g", 10, 5, "error", 1)], "config_id string, consumer_group string, last_seq long, records_processed_total long, status string, updated_at long")
    batch = spark.createDataFrame([("c", "g", 11, 2), ("c", "g", 12, 3), ("d", "g", 1, 1)], "config_id string, consumer_group string, seq long, at long")
    once = status.advance_state(state, batch)
    twice = status.advance_state(once, batch)
    wanted = {("c", 12, 7, "active"), ("d", 1, 1, "active")}
    for got in (once, twice):
        assert {(r.config_id, r.last_seq, r.records_processed_total, r.status) for r in got.collect()} == wanted


def test_paused_rows_with_maps_beyond_the_small_side(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_SIDE_BYTES", 0)
    rows = spark.createDataFrame([("a", {"k": "1"}), ("b", {"k": "2"})], "config_id string, key map<string,string>")
    paused = spark.createDataFrame([("b",)], "config_id string")
    for how in ("left_anti", "inner", "left"):
        kept = session.lookup_join(rows, paused, ["config_id"], how, max_rows=0)
        assert {r.config_id for r in kept.collect()} == {"left_anti": {"a"}, "inner": {"b"}, "left": {"a", "b"}}[how]
