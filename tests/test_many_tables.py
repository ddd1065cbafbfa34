"""Many tables in one apply, paused configs, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from changeflow.session import shared_dir
from changeflow.sources import messages
from changeflow.streaming import late, many, pipeline
from changeflow.streaming.held import Held

ENVELOPE = ("source string, schema string, `table` string, op string, key map<string,string>, "
            "before map<string,string>, after map<string,string>, ts_ms long, seq long")


def events(spark, changes):
    """``changes``: table, seq, op, key, fields."""
    return spark.createDataFrame([("s", "x", t, op, key, None, fields, seq * 1000, seq) for t, seq, op, key, fields in changes], ENVELOPE)


def made_up(seed, tables, n):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n):
        op = rng.choice("IUUD")
        key = {"id": rng.choice("abc"), "part": rng.choice(["1", "1|2", None])}
        if rng.random() < 0.5:
            key = dict(reversed(key.items()))
        out.append((rng.choice(tables), seq, op, key, None if op == "D" else {"v": str(seq), rng.choice("pq"): "1"}))
    return out


def live(changes, patch=False):
    state = {}
    for table, seq, op, key, fields in sorted(changes, key=lambda c: c[1]):
        unit = (table, key["id"], key["part"])
        if op == "D":
            state.pop(unit, None)
        else:
            state[unit] = {**(state.get(unit, {}) if patch else {}), **fields}
    return state


def rows_of(flow, patch):
    found = {}
    for r in flow.read().collect():
        key = r["row_key"]
        found[r["table"], key] = r["document"] if patch else r["after"]
    return found


def keyed(state):
    def text(value):
        return "null" if value is None else f'"{value}"'

    return {(t, f'{{"id":{text(i)},"part":{text(p)}}}'): v for (t, i, p), v in state.items()}


@pytest.mark.parametrize("patch", [False, True])
def test_batches_in_any_order_and_twice(spark, patch):
    changes = made_up(3, ["orders", "parts", "Lines"], 200)
    flow = many.ManyTables(spark, shared_dir(spark, "many"), patch=patch)
    for batch in (1, 0, 2, 1):
        flow.process(events(spark, [c for c in changes if c[1] % 3 == batch]), batch)
    assert rows_of(flow, patch) == keyed(live(changes, patch))
    one = flow.read("parts")
    assert {r["table"] for r in one.collect()} == {"parts"}
    assert "PartitionFilters: [isnotnull(table" in one._jdf.queryExecution().toString().replace("#", " #").replace(" #", "#")
    counted = flow.output("counts").groupBy("table").agg(F.sum("applied")).collect()
    assert {r[0]: r[1] for r in counted} == {t: sum(c[0] == t for c in changes) for t in ("orders", "parts", "Lines")}


def jobs(spark, tables):
    flow = many.ManyTables(spark, shared_dir(spark, "many"), rules=lambda: table_rules(spark, tables))
    rows = events(spark, made_up(1, tables, 150)).persist()
    rows.count()
    group = f"tables-{len(tables)}"
    spark.sparkContext.setJobGroup(group, group)
    flow.process(rows, 0)
    spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def table_rules(spark, tables):
    return spark.createDataFrame(
        [(f"r-{t}", t, "v", "range", "reject", True, '{"min": 50}') for t in tables],
        "id string, config_id string, field_name string, rule_type string, severity string, is_enabled boolean, rule_params string")


def test_jobs_do_not_grow_with_tables(spark):
    few, lots = jobs(spark, ["a", "b"]), jobs(spark, [f"t{i}" for i in range(40)])
    assert lots <= few + 2


def test_rules_of_tables(spark):
    changes = made_up(5, ["a", "b"], 120)
    flow = many.ManyTables(spark, shared_dir(spark, "many"), rules=lambda: table_rules(spark, ["a"]))
    flow.process(events(spark, changes), 0)
    kept = [c for c in changes if not (c[0] == "a" and c[2] != "D" and int(c[4]["v"]) < 50)]
    assert rows_of(flow, False) == keyed(live(kept))
    assert flow.output("violations").count() == len(changes) - len(kept)


def test_stream_with_dead_letters(spark):
    base = shared_dir(spark, "many")
    changes = made_up(7, ["a", "b"], 60)
    texts = messages.to_records(events(spark, changes)).select("value").unionByName(spark.createDataFrame([("{",), (None,)], "value string"))
    texts.repartition(3).write.parquet(f"{base}/in")
    flow = many.ManyTables(spark, f"{base}/out")
    source = pipeline.replay(spark, f"{base}/in", "value string", 1)
    pipeline.start(source, many.many_tables_batches(flow, spread=2), f"{base}/checkpoint", every=None).awaitTermination()
    assert rows_of(flow, False) == keyed(live(changes))
    assert flow.output("dead_letters").count() == 2


def switches(spark, rows):
    return spark.createDataFrame(rows, "command_id long, config_id string, command string, known long").withColumn(
        "issued_at", F.timestamp_seconds("command_id"))


def test_pause_resume_restart(spark):
    commands = switches(spark, [(1, "a", "pause", 1), (2, "a", "resume", 3), (3, "b", "pause", 0), (4, "c", "pause", 2),
                                (5, "c", "restart", 3), (6, "a", "pause", 4)])
    flow = many.ManyTables(spark, shared_dir(spark, "many"), commands=lambda n: commands.where(F.col("known") <= n))
    changes = [(t, 100 * n + i, "I", {"id": str(i), "part": None}, {"v": f"{n}"}) for n in range(5) for i, t in enumerate("abcd")]
    for n in (0, 1, 1, 2, 3, 2, 3, 4):
        flow.process(events(spark, [c for c in changes if c[1] // 100 == n]), n)
    seen = {(r["table"], int(r["batch"])): r["applied"] for r in flow.output("counts").collect()}
    assert seen == {("a", 0): 1, ("a", 3): 3, ("c", 0): 1, ("c", 1): 1, ("c", 3): 2, ("c", 4): 1, **{("d", n): 1 for n in range(5)}}
    assert sorted((r["config_id"], r["seq"]) for r in flow.waiting(4).collect()) == [("a", 400)] + [("b", 100 * n + 1) for n in range(5)]
    states = {(r["config_id"], n): (r["last_seq"], r["records_processed_total"], r["status"]) for n in range(5) for r in flow.state(n).collect()}
    assert states["a", 2] == (0, 1, "paused") and states["a", 3] == (300, 4, "active") and states["a", 4] == (300, 4, "paused")
    assert states["c", 2] == (102, 2, "paused") and states["c", 3] == (302, 4, "active") and ("b", 4) not in states
    assert {r["table"]: r["after"]["v"] for r in flow.read().collect()} == {"a": "3", "c": "4", "d": "4"}


def test_restart_begins_again(spark):
    state = spark.createDataFrame([("a", "g", 90, 5, "active"), ("b", "g", 80, 5, "paused")], "config_id string, consumer_group string, "
                                  "last_seq long, records_processed_total long, status string").withColumn("updated_at", F.current_timestamp())
    commands = switches(spark, [(1, "a", "restart", 0), (2, "b", "restart", 0)])
    from changeflow.operators import status
    got = {r.config_id: (r.last_seq, r.status) for r in status.with_pauses(
        status.restarted(state, commands, commands.where("command_id = 1")), commands).collect()}
    assert got == {"a": (90, "active"), "b": (0, "active")}


def test_events_without_a_config_pass(spark):
    held = Held(spark, shared_dir(spark, "held"))
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "config_id string, seq long")
    commands = switches(spark, [(1, "a", "pause", 0)])
    assert [tuple(r) for r in held.split(rows, commands, 0).collect()] == [(None, 1)]
    assert [tuple(r) for r in held.waiting(rows, 0).collect()] == [("a", 2)]
    assert sorted(r.seq for r in held.split(rows.where("seq = 1"), commands.limit(0), 1).collect()) == [1, 2]
    assert held.waiting(rows, 1).count() == 0


def test_every_row_is_accounted_for(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 5, 1)
    batches = [[(rng.choice(["a", None]), None if rng.random() < 0.05 else start + dt.timedelta(minutes=60 * n + rng.randrange(-400, 60)))
                for _ in range(80)] for n in range(5)]
    flow = late.CountedWindows(spark, shared_dir(spark, "late"), "ts", "2 hours")
    run = late.windowed_batches(flow, ["k"], {"n": F.lit(1)}, "30 minutes")
    for n in (0, 1, 2, 1, 2, 3, 4):
        run(spark.createDataFrame(batches[n], "k string, ts timestamp"), n)
    newest, expected, missed = None, {}, []
    for n, rows in enumerate(batches):
        mark = None if newest is None else newest - dt.timedelta(hours=2)
        for k, ts in rows:
            if ts is None or mark is not None and ts < mark:
                missed.append((n, k, ts, "undated" if ts is None else "late"))
            else:
                window = ts.replace(minute=ts.minute // 30 * 30)
                expected[k, window] = expected.get((k, window), 0) + 1
        newest = max([t for _, t in rows if t] + ([newest] if newest else []))
    assert {(r.k, r.window_start): r.n for r in flow.windows(["k"], ["n"]).collect()} == expected
    assert sorted(((int(r.batch), r.k, r.ts, r.arrival) for r in flow.late_rows().collect()), key=repr) == sorted(missed, key=repr)
    assert all(r.on_time + r.late + r.undated == 80 for r in flow.arrivals().collect())
    assert {r["arrival"] for r in flow.late_rows().collect()} == {"late", "undated"}
