"""Streaming: the events replayed as a stream through the same operators.

Each query takes what is there and stops; its checkpoint and its target lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.times import iso_text
from changeflow.operators import costs, metrics, status
from changeflow.plans.inputs import CHANGES_SQL, LOG_SQL, change_log, load, log_of
from changeflow.plans.metric_queries import _BATCHES_SQL, _SUMS, _target
from changeflow.plans.registry import query
from changeflow.schemas import META_OP, META_SEQ, META_TS, Rule, Transform
from changeflow.session import shared_dir
from changeflow.sources import changelog, messages
from changeflow.streaming import late, many, pipeline, windows
from changeflow.streaming.targets import create_target

KEYS = ["user_id", "shard"]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of them, as a stream."""
    schema = load(spark, sf_dir, "events").schema
    return pipeline.replay(spark, f"{sf_dir}/events.parquet*", schema, files_per_trigger=1000)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as JSON messages; every 29th is cut off."""
    decoded = changelog.decode(log_of(_stream(spark, sf_dir)))
    events = changelog.envelope(decoded, "src", "Shop", "Events", KEYS)
    records = messages.to_records(events)
    return records.select(F.when(
        F.get_json_object("value", "$.seq").cast("bigint") % 29 == 0, F.left("value", F.lit(40))
    ).otherwise(F.col("value")).alias("value"))


def _settings() -> pipeline.Settings:
    return pipeline.Settings(
        "shop",
        rules=[Rule("k-low", "k", "range", {"min": 10}, "reject"), Rule("k-high", "k", "range", {"max": 95}, "quarantine"),
               Rule("k-odd", "k", "regex", {"pattern": r"\d*[02468]$"}, "warn")],
        transforms=[Transform("k", "replace", {"pattern": "1", "replacement": "one"})])


def _run(spark: SparkSession, sf_dir: str, kind: str) -> pipeline.Pipeline:
    base = shared_dir(spark, f"stream-{kind}")
    text = ", ".join(f"{c} string" for c in [*KEYS, "k"])
    if kind == "replace":
        target = create_target("replace", spark, f"{base}/target", KEYS, spark.createDataFrame([], text).schema)
    else:
        target = create_target("patch", spark, f"{base}/target", KEYS)
    flow = pipeline.Pipeline(target, f"{base}/side", _settings, ["k"] if kind == "replace" else None, spread=8)
    source = _messages(spark, sf_dir)
    pipeline.start(source, pipeline.parsed_batches(flow), f"{base}/checkpoint", every=None).awaitTermination()
    return flow


_APPLIED_SQL = f"""
SELECT split_part(row_key, '|', 1) AS user_id, split_part(row_key, '|', 2) AS shard, op, ts_ms, seq,
       replace(k, '1', 'one') AS k
FROM ({CHANGES_SQL}) WHERE seq % 29 <> 0 AND (op = 'D' OR CAST(k AS DOUBLE) BETWEEN 10 AND 95)
"""


@query("stream_apply", f"""
SELECT user_id, shard, k, op AS _cdc_op, ts_ms AS _cdc_ts, seq AS _cdc_seq FROM (
  SELECT * FROM ({_APPLIED_SQL}) QUALIFY row_number() OVER (PARTITION BY user_id, shard ORDER BY seq DESC) = 1)
WHERE op <> 'D'
""")
def stream_apply(spark, sf_dir):
    """Parse, check, route, transform and apply to a target whose rows are replaced."""
    return _run(spark, sf_dir, "replace").target.read().select(*KEYS, "k", META_OP, META_TS, META_SEQ)


@query("stream_patch", f"""
WITH a AS ({_APPLIED_SQL}),
d AS (SELECT user_id, shard, max(seq) AS deleted FROM a WHERE op = 'D' GROUP BY ALL),
l AS (SELECT a.* FROM a LEFT JOIN d USING (user_id, shard) WHERE op <> 'D' AND seq > COALESCE(deleted, -1))
SELECT user_id, shard, arg_max(k, seq) AS k, max(seq) AS _cdc_seq FROM l GROUP BY user_id, shard
""")
def stream_patch(spark, sf_dir):
    documents = _run(spark, sf_dir, "patch").target.read()
    return documents.select(*KEYS, F.try_element_at("document", F.lit("k")).alias("k"), META_SEQ)


@query("stream_side_outputs", f"""
SELECT 'dead_letters' AS output, '' AS kind, count(*) AS n FROM ({CHANGES_SQL}) WHERE seq % 29 = 0
UNION ALL SELECT 'held', CASE WHEN CAST(k AS DOUBLE) < 10 THEN 'reject' ELSE 'quarantine' END, count(*)
FROM ({CHANGES_SQL}) WHERE seq % 29 <> 0 AND (CAST(k AS DOUBLE) < 10 OR CAST(k AS DOUBLE) > 95) GROUP BY 2
UNION ALL SELECT 'violations', r, count(*) FROM (
  SELECT unnest(list_filter([CASE WHEN CAST(k AS DOUBLE) < 10 THEN 'k-low' END,
                             CASE WHEN CAST(k AS DOUBLE) > 95 THEN 'k-high' END,
                             CASE WHEN CAST(k AS BIGINT) % 2 = 1 THEN 'k-odd' END], lambda x: x IS NOT NULL)) AS r
  FROM ({CHANGES_SQL}) WHERE seq % 29 <> 0 AND k IS NOT NULL) GROUP BY r
UNION ALL SELECT 'counts', 'applied', count(*) FROM ({_APPLIED_SQL})
""")
def stream_side_outputs(spark, sf_dir):
    flow = _run(spark, sf_dir, "replace")

    def counted(name: str, kind) -> DataFrame:
        rows = flow.side_output(name).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
        return rows.select(F.lit(name).alias("output"), "kind", "n")

    applied = flow.side_output("counts").agg(F.sum("applied").alias("n"))
    return counted("dead_letters", F.lit("")).unionByName(counted("held", F.col("route"))).unionByName(
        counted("violations", F.col("rule_id"))).unionByName(
        applied.select(F.lit("counts").alias("output"), F.lit("applied").alias("kind"), "n"))


@query("stream_state_written", f"""
SELECT 'shop' AS config_id, 'target' AS consumer_group, max(seq) AS last_seq, count(*) AS records_processed_total,
       'active' AS status, (SELECT count(*) FROM ({_APPLIED_SQL})) AS latency_samples
FROM ({CHANGES_SQL}) WHERE seq % 29 <> 0
""")
def stream_state_written(spark, sf_dir):
    """What the pipeline says of itself: state after the last batch, and how many applied events gave a latency."""
    flow = _run(spark, sf_dir, "replace")
    samples = flow.side_output("latency").groupBy(F.lit("shop").alias("config_id")).agg(F.sum("le_inf").alias("latency_samples"))
    state = flow.state().select("config_id", "consumer_group", "last_seq", "records_processed_total", "status")
    return state.join(samples, "config_id")


@query("stream_positions", f"""
SELECT 'dead_letters' AS output, "partition", "offset" FROM (SELECT *, seq % 6 AS "partition", seq // 6 AS "offset" FROM ({CHANGES_SQL}))
WHERE seq % 29 = 0
UNION ALL SELECT 'held', "partition", "offset" FROM (SELECT *, seq % 6 AS "partition", seq // 6 AS "offset" FROM ({CHANGES_SQL}))
WHERE seq % 29 <> 0 AND (CAST(k AS DOUBLE) < 10 OR CAST(k AS DOUBLE) > 95)
""")
def stream_positions(spark, sf_dir):
    """Where the messages stood that could not be parsed or were held back: six partitions, dealt by sequence."""
    base = shared_dir(spark, "stream-positions")
    target = create_target("patch", spark, f"{base}/target", KEYS)
    flow = pipeline.Pipeline(target, f"{base}/side", _settings, None, spread=8)
    seq = F.regexp_extract("value", '"seq":([0-9]+)', 1).cast("bigint")
    records = messages.to_records(changelog.envelope(changelog.decode(log_of(_stream(spark, sf_dir))), "src", "Shop", "Events", KEYS))
    placed = records.select("value", seq.alias("seq")).select(
        F.when(F.col("seq") % 29 == 0, F.left("value", F.lit(40))).otherwise(F.col("value")).alias("value"),
        (F.col("seq") % 6).alias("partition"), F.floor(F.col("seq") / 6).alias("offset"))
    pipeline.start(placed, pipeline.parsed_batches(flow), f"{base}/checkpoint", every=None).awaitTermination()
    both = [flow.side_output(n).select(F.lit(n).alias("output"), "partition", "offset") for n in ("dead_letters", "held")]
    return both[0].unionByName(both[1])


def _updated(spark: SparkSession, rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Run an update query, keep the changed windows of each batch, and read the newest state of every window.

    A repeated batch replaces its own folder. Windows that are still open are there with what they hold so far.
    """
    base = shared_dir(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer = rows.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])
    return status.latest_by(spark.read.schema(schema).parquet(f"{base}/out"), by, ["batch"]).drop("batch")


def _written(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Run an append query into Parquet and read it back."""
    base = shared_dir(spark, name)
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query("stream_costs", f"""
SELECT config_id, org_id, target_type, strftime(h, '%Y-%m-%dT%H:%M:%S') AS period_start, records_processed,
       bytes_transferred, compute_ms
FROM (SELECT config_id, org_id, target_type, date_trunc('hour', ts) AS h, {_SUMS} FROM ({_BATCHES_SQL}) GROUP BY ALL)
""")
def stream_costs(spark, sf_dir):
    """All hours, open ones too; an hour is final once the watermark, one hour late, has passed its end."""
    key = F.col("event_id")
    batches = _stream(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("config_id"),
        F.concat(F.lit("o"), (F.col("user_id") % 10).cast("string")).alias("org_id"),
        _target().alias("target_type"), ((key * 31) % 5000 + 1).alias("records"),
        ((key * 104729) % 50000000).alias("bytes"), ((key * 7919) % 60000).alias("compute_ms"),
        F.col("ts").cast("timestamp").alias("ts"))
    by = ["config_id", "org_id", "target_type", "period_start"]
    hours = costs.with_costs(_updated(spark, windows.hourly_usage(batches), by, "stream-costs"))
    return hours.select(
        "config_id", "org_id", "target_type", iso_text(F.col("period_start")).alias("period_start"),
        "records_processed", "bytes_transferred", "compute_ms")


@query("stream_dedup", f"SELECT table_name, seq_id, op_type FROM ({LOG_SQL})")
def stream_dedup(spark, sf_dir):
    """Every fifth row of the log arrives twice."""
    log = log_of(_stream(spark, sf_dir)).select("table_name", "seq_id", "op_type", "changed_at")
    copies = F.when(F.col("seq_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    repeated = log.withColumn("copy", F.explode(copies)).drop("copy")
    return _written(spark, windows.deduplicated(repeated, ["table_name", "seq_id"]), "stream-dedup").drop("changed_at")


@query("stream_latency", """
SELECT event_type, epoch_us(m) // 1000000 AS start_s, count(*) FILTER (WHERE latency_ms <= 1000) AS le_1000,
       count(*) FILTER (WHERE latency_ms <= 30000) AS le_30000, count(*) AS le_inf, max(latency_ms) AS max
FROM (SELECT event_type, date_trunc('minute', ts) AS m, (event_id * 7919) % 60000 AS latency_ms FROM events)
GROUP BY event_type, m
""")
def stream_latency(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") * 7919) % 60000).alias("latency_ms"))
    counts = windows.latency_windows(rows, ["event_type"], "ts")
    minutes = _updated(spark, counts, ["event_type", "window_start"], "stream-latency")
    return minutes.select("event_type", F.unix_seconds("window_start").alias("start_s"), "le_1000", "le_30000", "le_inf",
                         "max")


@query("stream_rates", """
WITH w AS (SELECT event_type, (epoch_us(ts) // 60000000 - o) * 60 AS start_s FROM events, range(0, 5) r(o))
SELECT event_type, start_s, count(*) AS events, count(*) / CAST(300 AS DOUBLE) AS per_second
FROM w GROUP BY event_type, start_s
""")
def stream_rates(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    panes = _updated(spark, windows.event_panes(rows, ["event_type"], "ts", "1 minute"), ["event_type", "pane_start"],
                     "stream-rates")
    return metrics.rates_of_panes(panes, ["event_type"], "pane_start", 300, 60).withColumnRenamed("window_start_s", "start_s")


# A rule for each of five tables, from the regions: too small values are refused in two of them, and reported in the others.
def _table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return load(spark, sf_dir, "region").select(
        F.concat(F.lit("low"), key.cast("string")).alias("id"), F.concat(F.lit("events_"), key.cast("string")).alias("config_id"),
        F.lit("k").alias("field_name"), F.lit("range").alias("rule_type"), F.when(key < 2, "reject").otherwise("warn").alias("severity"),
        F.lit(True).alias("is_enabled"), F.lit('{"min": 10}').alias("rule_params"))


def _table_messages(log: DataFrame) -> DataFrame:
    events = changelog.envelope(changelog.decode(log), "src", "Shop", F.col("table_name"), KEYS)
    return messages.to_records(events).select("value")


@query("stream_many_tables", f"""
SELECT table_name AS "table", split_part(row_key, '|', 1) AS user_id, split_part(row_key, '|', 2) AS shard, k, op AS _cdc_op,
       ts_ms AS _cdc_ts, seq AS _cdc_seq
FROM (SELECT * FROM ({CHANGES_SQL}) WHERE op = 'D' OR CAST(k AS DOUBLE) >= 10 OR table_name NOT IN ('events_0', 'events_1')
      QUALIFY row_number() OVER (PARTITION BY table_name, row_key ORDER BY seq DESC) = 1)
WHERE op <> 'D'
""")
def stream_many_tables(spark, sf_dir):
    """All tables of a stream through one reduction and one write, with a rule for each."""
    base = shared_dir(spark, "stream-many")
    flow = many.ManyTables(spark, f"{base}/target", rules=lambda: _table_rules(spark, sf_dir))
    source = _table_messages(log_of(_stream(spark, sf_dir)))
    pipeline.start(source, many.many_tables_batches(flow, spread=8), f"{base}/checkpoint", every=None).awaitTermination()
    rows = flow.read()
    return rows.select("table", *[F.col("key")[k].alias(k) for k in KEYS], F.try_element_at("after", F.lit("k")).alias("k"),
                       META_OP, META_TS, META_SEQ)


def _in_turns(spark: SparkSession, rows: DataFrame, turn: str, turns: int, base: str, run, columns: list[str]) -> None:
    """Write the rows of one turn after the other, and run the stream over what is new each time, from its checkpoint."""
    for number in range(turns):
        rows.where(F.col(turn) == number).select(*columns).write.mode("append").parquet(f"{base}/in")
        source = pipeline.replay(spark, f"{base}/in", rows.select(*columns).schema, files_per_trigger=1_000_000)
        pipeline.start(source, run, f"{base}/checkpoint", every=None).awaitTermination()


# Switches of five configs: from which batch each is known.
_SWITCHES = [(1, "events_1", "pause", 1), (2, "events_1", "resume", 3), (3, "events_2", "pause", 0), (4, "events_3", "pause", 1),
             (5, "events_3", "restart", 2), (6, "events_4", "pause", 2), (7, "events_4", "resume", 3)]

_TURNS_SQL = f"""
SELECT *, (seq - min(seq) OVER ()) * 4 // (max(seq) OVER () - min(seq) OVER () + 1) AS turn FROM ({CHANGES_SQL})
"""

_PLACED_SQL = f"""
SELECT table_name, seq, CASE
  WHEN table_name = 'events_1' AND turn IN (1, 2) THEN 3 WHEN table_name = 'events_2' THEN NULL
  WHEN table_name = 'events_3' AND turn = 1 THEN 2 WHEN table_name = 'events_4' AND turn = 2 THEN 3 ELSE turn END AS at_batch
FROM ({_TURNS_SQL})
"""


@query("stream_paused", f"""
WITH p AS ({_PLACED_SQL}), b AS (SELECT unnest(range(0, 4)) AS batch)
SELECT table_name AS config_id, batch, count(*) FILTER (WHERE at_batch = batch) AS applied,
       max(CASE WHEN table_name <> 'events_3' OR batch < 2 OR at_batch >= 2 THEN seq END) AS last_seq,
       count(*) AS records_processed_total,
       CASE WHEN table_name = 'events_1' AND batch IN (1, 2) OR table_name = 'events_3' AND batch = 1
              OR table_name = 'events_4' AND batch = 2 THEN 'paused' ELSE 'active' END AS status
FROM p JOIN b ON at_batch <= batch GROUP BY table_name, batch
UNION ALL SELECT table_name, 4, count(*), max(seq), count(*), 'waiting' FROM p WHERE at_batch IS NULL GROUP BY table_name
""")
def stream_paused(spark, sf_dir):
    """Four batches with pauses, a resume and a restart: what each batch applied, the state after it, and what still waits."""
    base = shared_dir(spark, "stream-paused")
    switches = spark.createDataFrame(_SWITCHES, "command_id long, config_id string, command string, known long").withColumn(
        "issued_at", F.timestamp_seconds("command_id"))
    flow = many.ManyTables(spark, f"{base}/target", commands=lambda batch: switches.where(F.col("known") <= batch))
    log = change_log(spark, sf_dir)
    first, last = log.agg(F.min("seq_id"), F.max("seq_id")).first()
    turn = F.expr(f"(seq_id - {first}) * 4 div {last - first + 1}")
    values = _table_messages(log).withColumn("seq_id", F.get_json_object("value", "$.seq").cast("bigint")).withColumn("turn", turn)
    seen = []

    def run(batch: DataFrame, number: int) -> None:
        seen.append(number)
        many.many_tables_batches(flow, spread=8)(batch, number)

    _in_turns(spark, values, "turn", 4, base, run, ["value"])
    counts = flow.output("counts").select(F.col("table").alias("config_id"), F.col("batch").cast("bigint").alias("batch"), "applied")
    states = flow.output("state").withColumn("batch", F.col("batch").cast("bigint"))
    result = states.join(counts, ["config_id", "batch"], "left").select(
        "config_id", "batch", F.coalesce("applied", F.lit(0)).cast("bigint").alias("applied"), "last_seq", "records_processed_total", "status")
    waiting = flow.waiting(max(seen)).groupBy("config_id").agg(
        F.count("*").alias("applied"), F.max("seq").alias("last_seq"))
    return result.unionByName(waiting.select(
        "config_id", F.lit(4).cast("bigint").alias("batch"), "applied", "last_seq", F.col("applied").alias("records_processed_total"),
        F.lit("waiting").alias("status")))


_ARRIVALS_SQL = """
WITH a AS (SELECT event_id, event_type, CASE WHEN event_id % 97 > 0 THEN ts END AS ts,
                  least(4, (epoch_us(ts) // 86400000000 - min(epoch_us(ts) // 86400000000) OVER () +
                            CASE WHEN event_id % 10 = 0 THEN 3 ELSE 0 END) // 7) AS turn FROM events),
m AS (SELECT b.turn, max(a.ts) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT turn FROM a) b LEFT JOIN a ON a.turn < b.turn GROUP BY b.turn)
SELECT a.*, CASE WHEN ts IS NULL THEN 'undated' WHEN ts < mark THEN 'late' ELSE 'on_time' END AS arrival FROM a JOIN m USING (turn)
"""


@query("stream_late", f"""
WITH r AS ({_ARRIVALS_SQL})
SELECT 'window' AS kind, event_type, epoch_us(date_trunc('hour', ts)) // 1000000 AS at, count(*) AS n FROM r
WHERE arrival = 'on_time' GROUP BY ALL
UNION ALL SELECT arrival, event_type, turn, count(*) FROM r WHERE arrival <> 'on_time' GROUP BY ALL
UNION ALL SELECT 'all', NULL, turn, count(*) FROM r GROUP BY ALL
""")
def stream_late(spark, sf_dir):
    """Every tenth event comes three days late: hourly counts of what was on time, and what was not, by batch."""
    base = shared_dir(spark, "stream-late")
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.expr("unix_micros(ts) div 86400000000")
    first = events.agg(F.min(day)).first()[0]
    turn = F.least(F.lit(4), F.floor((day - first + F.when(F.col("event_id") % 10 == 0, 3).otherwise(0)) / 7))
    rows = events.withColumn("turn", turn).withColumn("ts", F.when(F.col("event_id") % 97 > 0, F.col("ts")))
    flow = late.CountedWindows(spark, f"{base}/out", "ts", "1 hour")
    run = late.windowed_batches(flow, ["event_type"], {"n": F.lit(1)})
    _in_turns(spark, rows, "turn", 5, base, run, ["event_id", "event_type", "ts"])
    hours = flow.windows(["event_type"], ["n"]).select(
        F.lit("window").alias("kind"), "event_type", F.unix_seconds("window_start").alias("at"), "n")
    others = flow.late_rows().groupBy(F.col("arrival").alias("kind"), "event_type", F.col("batch").cast("bigint").alias("at")).agg(
        F.count("*").alias("n"))
    every = flow.arrivals().select(
        F.lit("all").alias("kind"), F.lit(None).cast("string").alias("event_type"), F.col("batch").cast("bigint").alias("at"),
        (F.col("on_time") + F.col("late") + F.col("undated")).alias("n"))
    return hours.unionByName(others).unionByName(every)
