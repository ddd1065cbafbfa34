import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators import apply
from changeflow.schemas import Rule, Transform
from changeflow.session import shared_dir
from changeflow.sources import messages
from changeflow.streaming import pipeline, windows
from changeflow.streaming.targets import create_target, register_target

ENVELOPE = ("source string, schema string, `table` string, op string, key map<string,string>, "
            "before map<string,string>, after map<string,string>, ts_ms long, seq long")


def events(spark, changes):
    """``changes``: seq, op, key, fields."""
    rows = [("s", "x", "t", op, {"id": key}, None, fields, seq * 1000, seq) for seq, op, key, fields in changes]
    return spark.createDataFrame(rows, ENVELOPE)


def random_changes(seed, n=120):
    rng = random.Random(seed)
    result = []
    for seq in range(1, n):
        op = rng.choice("IUUD")
        result.append((seq, op, rng.choice("abcdef"), None if op == "D" else {"v": str(seq), rng.choice("pq"): "1"}))
    return result


def live(changes):
    rows = {}
    for seq, op, key, fields in sorted(changes):
        rows[key] = None if op == "D" else (fields["v"], seq)
    return {k: v for k, v in rows.items() if v}


def write_files(spark, changes, base, files):
    records = messages.to_records(events(spark, changes))
    for i in range(files):
        seq = F.get_json_object("value", "$.seq").cast("int")
        records.where(seq % files == i).select("value").coalesce(1).write.mode("append").parquet(f"{base}/in")


def replace_pipeline(spark, base, settings=pipeline.Settings, columns=("v",)):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", *columns)])
    target = create_target("replace", spark, f"{base}/target", ["id"], schema)
    return pipeline.Pipeline(target, f"{base}/side", settings, list(columns), spread=2)


def run(spark, flow, base, files_per_trigger=1):
    source = pipeline.replay(spark, f"{base}/in", "value string", files_per_trigger)
    query = pipeline.start(source, pipeline.parsed_batches(flow), f"{base}/checkpoint", every=None)
    query.awaitTermination()
    return query


def rows_of(target):
    return {r.id: (r.v, r._cdc_seq) for r in target.read().collect()}


def test_interleaved_batches_restart_and_replay(spark):
    """Files hold every third change each, so batches arrive out of sequence."""
    base = shared_dir(spark, "t")
    changes = random_changes(1)
    write_files(spark, changes[:60], base, 3)
    flow = replace_pipeline(spark, base)
    flow.compact_every = 2
    run(spark, flow, base)
    assert rows_of(flow.target) == live(changes[:60])
    write_files(spark, changes[60:], base, 2)
    run(spark, flow, base)
    assert rows_of(flow.target) == live(changes)
    batches = flow.side_output("counts").select("batch").distinct().count()
    assert batches == 5
    flow.process(events(spark, changes[:30]), 0)
    flow.process(events(spark, changes[:30]), 0)
    assert flow.target.count() == len(live(changes))


def test_routes_and_dead_letters(spark):
    base = shared_dir(spark, "t")
    changes = [(1, "I", "a", {"v": "5"}), (2, "I", "b", {"v": "500"}), (3, "I", "c", {"v": "50"}), (4, "U", "a", None),
               (5, "D", "c", None), (6, "I", "d", {"v": "7"})]
    settings = pipeline.Settings("cfg", [
        Rule("q", "v", "range", {"max": 40}, "quarantine"), Rule("r", "v", "range", {"max": 400}, "reject"),
        Rule("w", "v", "length", {"min": 9}, "warn")], [Transform("v", "replace", {"pattern": "7", "replacement": "z"})])
    write_files(spark, changes, base, 1)
    spark.createDataFrame([("{bad",)], "value string").write.mode("append").parquet(f"{base}/in")
    flow = replace_pipeline(spark, base, lambda: settings)
    run(spark, flow, base, 10)
    assert rows_of(flow.target) == {"a": ("5", 1), "d": ("z", 6)}
    assert sorted((r.route, r.seq) for r in flow.side_output("held").collect()) == [("quarantine", 3), ("reject", 2)]
    assert flow.side_output("dead_letters").count() == 1
    assert flow.side_output("violations").groupBy("rule_id").count().where("rule_id = 'w'").first()["count"] == 4
    assert tuple(flow.side_output("counts").select("inserted", "updated", "deleted").first()) == (2, 0, 1)


def test_failed_batch_is_replayed(spark):
    base = shared_dir(spark, "t")
    changes = random_changes(2, 30)
    write_files(spark, changes, base, 1)
    calls = []

    def settings():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("no metadata")
        return pipeline.Settings()

    flow = replace_pipeline(spark, base, settings)
    with pytest.raises(Exception, match="no metadata"):
        run(spark, flow, base)
    run(spark, flow, base)
    assert rows_of(flow.target) == live(changes)


def test_rules_are_read_for_every_batch(spark):
    base = shared_dir(spark, "t")
    current = [pipeline.Settings(rules=[Rule("r", "v", "enum", {"values": []}, "reject")]), pipeline.Settings()]
    flow = replace_pipeline(spark, base, lambda: current[0])
    flow.process(events(spark, [(1, "I", "a", {"v": "1"})]), 0)
    current.pop(0)
    flow.process(events(spark, [(2, "I", "b", {"v": "2"})]), 1)
    assert rows_of(flow.target) == {"b": ("2", 2)}


def test_compaction_keeps_deletes_until_they_expire(spark):
    base = shared_dir(spark, "t")
    flow = replace_pipeline(spark, base)
    target = flow.target
    target.load(spark.createDataFrame([("a", "0"), ("b", "0"), ("z", "0")], "id string, v string"), 0)
    flow.process(events(spark, [(5, "U", "a", {"v": "5"}), (6, "D", "b", None)]), 0)
    before = rows_of(target)
    assert before == {"a": ("5", 5), "z": ("0", 0)}
    target.compact()
    assert rows_of(target) == before and target.stored().count() == 3
    flow.process(events(spark, [(4, "U", "b", {"v": "old"}), (3, "U", "a", {"v": "old"})]), 1)
    assert rows_of(target) == before
    target.compact(drop_deletes_before=F.lit("1970-01-01 02:00:00").cast("timestamp"))
    assert rows_of(target) == before and target.stored().count() == 2


def test_bucketed_base_agrees_and_is_not_shuffled(spark):
    base = shared_dir(spark, "t")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "v")])
    target = create_target("replace", spark, f"{base}/target", ["id"], schema, buckets=4)
    plain = create_target("replace", spark, f"{base}/plain", ["id"], schema)
    changes = random_changes(7)
    changes.append((500, "I", None, {"v": "n"}))
    random.Random(7).shuffle(changes)
    for i in range(4):
        batch = events(spark, changes[i * 30:i * 30 + 30])
        rows = pipeline.keyed_payload(apply.effective(batch), ["id"], ["v"])
        target.apply(rows, i)
        plain.apply(rows, i)
        if i % 2:
            target.compact()
        assert rows_of(target) == rows_of(plain)
    assert rows_of(target) == live(changes)
    target.apply(rows, 9)
    spark.sql(f"DROP TABLE {target._table(target._home() + '/base')}")
    assert rows_of(target) == live(changes)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = target.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin"):plan.index("SortAggregate", plan.index("SortMergeJoin"))]
    assert "Bucketed: true" in join and "Exchange" not in join.split("Bucketed: true")[0]


def test_unfinished_folders_are_not_read(spark):
    base = shared_dir(spark, "t")
    flow = replace_pipeline(spark, base)
    flow.process(events(spark, [(1, "I", "a", {"v": "1"})]), 0)
    reduced = flow.target.reduce(apply.effective(pipeline.keyed_payload(
        events(spark, [(2, "I", "b", {"v": "2"})]), ["id"], ["v"]), after=None))
    reduced.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{base}/target/gen=0/batch=1")
    assert rows_of(flow.target) == {"a": ("1", 1)}


def test_patch_target(spark):
    base = shared_dir(spark, "t")
    target = create_target("patch", spark, f"{base}/target", ["id"])
    flow = pipeline.Pipeline(target, f"{base}/side", pipeline.Settings)
    changes = random_changes(3)
    shuffled = changes[:]
    random.Random(3).shuffle(shuffled)
    expected = {}
    for _, op, key, fields in changes:
        if op == "D":
            expected.pop(key, None)
        else:
            expected.setdefault(key, {}).update(fields)
    for i in range(4):
        flow.process(events(spark, shuffled[i * 30:i * 30 + 30]), i)
        if i == 1:
            target.compact()
    assert {r.id: r.document for r in target.read().collect()} == expected
    assert target.count() == len(expected)


def test_target_registry(spark):
    with pytest.raises(ValueError):
        create_target("no_such_kind")
    register_target("mine", lambda: "made")
    assert create_target("mine") == "made"


def test_many_tables_and_settings_from_tables(spark):
    base = shared_dir(spark, "t")
    rules = spark.createDataFrame(
        [("1", "A", "v", "range", '{"max": 5}', "reject", True)],
        "id string, config_id string, field_name string, rule_type string, rule_params string, severity string, "
        "is_enabled boolean")
    transforms = spark.createDataFrame(
        [("B", "v", "replace", '{"pattern": "9", "replacement": "n"}', 1, True)],
        "config_id string, source_field string, transform_type string, transform_params string, execution_order int, "
        "is_enabled boolean")
    routes = {name: replace_pipeline(spark, f"{base}/{name}", pipeline.settings_from_tables(
        lambda: (rules, transforms), name)) for name in "AB"}
    rows = [("s", "x", t, "I", {"id": "k"}, None, {"v": v}, 1, i) for i, (t, v) in enumerate(
        [("A", "3"), ("A", "9"), ("B", "9"), ("C", "1")])]
    records = messages.to_records(spark.createDataFrame(rows, ENVELOPE)).select("value")
    pipeline.routed_batches(routes, f"{base}/side", spread=1)(records, 0)
    assert rows_of(routes["A"].target) == {"k": ("3", 0)} and rows_of(routes["B"].target) == {"k": ("n", 2)}
    dead = spark.read.parquet(f"{base}/side/dead_letters").collect()
    assert [r.parse_error for r in dead] == ["no pipeline for table"]


def stream_out(spark, rows, base):
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def test_deduplication_across_batches(spark):
    base = shared_dir(spark, "t")
    for part in (range(0, 20), range(15, 20)):
        spark.createDataFrame([("t", i) for i in part], "table_name string, seq long").withColumn(
            "changed_at", F.timestamp_seconds(F.col("seq") * 60 + 86400)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = pipeline.replay(spark, f"{base}/in", "table_name string, seq long, changed_at timestamp")
    assert stream_out(spark, windows.deduplicated(source, ["table_name", "seq"]), base).count() == 20


def test_hourly_usage_windows(spark):
    base = shared_dir(spark, "t")
    ddl = "config_id string, org_id string, target_type string, records long, bytes long, compute_ms long, ts timestamp"
    rows = spark.range(8).select(
        F.lit("c").alias("config_id"), F.lit("o").alias("org_id"), F.lit("t").alias("target_type"),
        F.lit(2).cast("long").alias("records"), F.lit(3).cast("long").alias("bytes"),
        F.lit(1000).cast("long").alias("compute_ms"), F.timestamp_seconds(F.col("id") * 1800).alias("ts"))
    rows.coalesce(1).write.parquet(f"{base}/in")
    out = stream_out(spark, windows.hourly_usage(pipeline.replay(spark, f"{base}/in", ddl)), base)
    got = sorted((r.period_start.hour, r.records_processed, r.compute_ms) for r in out.collect())
    assert got == [(0, 4, 2000), (1, 4, 2000)]


def test_patch_expiry_keeps_deleted_fields_deleted(spark):
    target = create_target("patch", spark, shared_dir(spark, "patch-expiry"), ["id"])
    target.ensure()
    for batch, rows in enumerate([[(1, "I", "a", {"x": "1"}), (2, "I", "b", {"x": "2"})], [(3, "D", "a", None), (4, "D", "b", None)],
                                  [(5, "I", "b", {"y": "3"})]]):
        target.apply(pipeline.keyed_payload(events(spark, rows), ["id"], None), batch)
    before = {r["id"]: r.document for r in target.read().collect()}
    target.compact(drop_deletes_before=F.lit("1970-01-01 09:00:00").cast("timestamp"))
    assert {r["id"]: r.document for r in target.read().collect()} == before == {"b": {"y": "3"}}


def test_state_and_errors_of_batches(spark):
    base = shared_dir(spark, "t")
    flow = replace_pipeline(spark, base, lambda: pipeline.Settings("c"))
    assert flow.state().count() == 0
    first = events(spark, [(5, "I", "a", {"v": "5"}), (6, "X", "a", {"v": "6"})])
    second = events(spark, [(3, "I", "b", {"v": "3"}), (9, "D", "a", None)])

    def seen():
        row = flow.state().first()
        return row.last_seq, row.records_processed_total, row.status

    flow.process(first, 0)
    assert seen() == (6, 2, "active")
    flow.process(second, 1)
    flow.process(second, 1)
    assert seen() == (9, 4, "active")
    assert flow.side_output("latency").agg(F.sum("le_inf")).first()[0] == 3
    flow.process(first, 0)
    assert seen() == (9, 4, "active")

    apply_rows, flow.target.apply = flow.target.apply, lambda rows, batch_id: 1 / 0
    with pytest.raises(ZeroDivisionError):
        flow.process(second, 2)
    assert seen() == (9, 4, "error") and "division" in flow.state().first().error_message
    flow.target.apply = apply_rows
    flow.process(events(spark, [(10, "I", "c", {"v": "1"})]), 2)
    assert seen() == (10, 5, "active") and flow.state().first().error_message is None


def test_a_paused_pipeline_holds_its_events(spark):
    base = shared_dir(spark, "paused")
    switches = spark.createDataFrame([(1, "c", "pause", 1), (2, "c", "resume", 3), (3, "other", "pause", 0)],
                                     "command_id long, config_id string, command string, known long").withColumn(
        "issued_at", F.timestamp_seconds("command_id"))
    flow = replace_pipeline(spark, base, lambda: pipeline.Settings("c"))
    flow.commands = lambda batch: switches.where(F.col("known") <= batch)
    seen = []
    for batch in (0, 1, 2, 2, 3):
        flow.process(events(spark, [(10 * batch + 1, "I", f"k{batch}", {"v": str(batch)})]), batch)
        state = flow.state().first()
        seen.append((sorted(r.id for r in flow.target.read().collect()), state.last_seq, state.status))
    assert seen == [(["k0"], 1, "active"), (["k0"], 1, "paused"), (["k0"], 1, "paused"), (["k0"], 1, "paused"),
                    (["k0", "k1", "k2", "k3"], 31, "active")]


def test_tasks_of_a_batch_grow_with_its_source(spark):
    base = shared_dir(spark, "spread")
    flow = replace_pipeline(spark, base)
    batch = spark.range(0, 600, 1, 5).select(F.concat(F.lit("bad"), F.col("id").cast("string")).alias("value"))
    pipeline.parsed_batches(flow)(batch, 0)
    dead = spark.read.parquet(f"{base}/side/dead_letters")
    assert dead.count() == 600
    # Two tasks for each of five partitions, each of which wrote a file.
    files = dead.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) == 10 and all(40 <= r["count"] <= 80 for r in files)


def test_spread_is_off_without_a_number_and_takes_an_empty_source(spark):
    texts = spark.range(0, 10, 1, 3).select(F.col("id").cast("string").alias("value"))
    assert pipeline.spread_out(texts, 0) is texts
    empty = spark.createDataFrame(spark.sparkContext.emptyRDD(), "value string")
    assert empty.rdd.getNumPartitions() >= 0 and pipeline.spread_out(empty, 4).count() == 0
