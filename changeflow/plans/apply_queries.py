"""Keyed apply, chunked load and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import apply, status
from changeflow.plans.inputs import CHANGES_SQL, HALF, at, changes, load
from changeflow.plans.registry import query
from changeflow.schemas import META_OP, META_SEQ, META_TS, META_UPDATED, TARGET_TYPES
from changeflow.session import shared_dir
from changeflow.sources import snapshot

_STATE = ["row_key", "k", META_OP, META_TS, META_SEQ]

_STATE_SQL = f"""
SELECT row_key, k, op AS _cdc_op, ts_ms AS _cdc_ts, seq AS _cdc_seq FROM ({CHANGES_SQL})
QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY seq DESC) = 1
"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply.effective(changes(spark, sf_dir), after=None)
    return rows.select("row_key", "k", "op", "ts_ms", "seq", "changed_at")


def _before(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("changed_at") < at(HALF)).drop("changed_at")


def _after(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("changed_at") >= at(HALF)).drop("changed_at")


@query("current_state", f"SELECT * FROM ({_STATE_SQL}) WHERE _cdc_op <> 'D'")
def current_state(spark, sf_dir):
    return apply.with_meta(apply.current_state(_keyed(spark, sf_dir).drop("changed_at"), ["row_key"])).select(*_STATE)


@query("current_state_deletes_first", f"""
SELECT row_key, k, op AS _cdc_op, ts_ms AS _cdc_ts, seq AS _cdc_seq, 1706659200000 AS _cdc_updated_at FROM ({CHANGES_SQL}) WHERE op <> 'D'
QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY seq DESC) = 1
""")
def current_state_deletes_first(spark, sf_dir):
    rows = _keyed(spark, sf_dir).drop("changed_at")
    state = apply.current_state(rows, ["row_key"], order="deletes_first")
    return apply.with_meta(state, updated_ms=F.lit(1706659200000)).select(*_STATE, META_UPDATED)


@query("apply_merge_replace", f"""
SELECT split_part(row_key, '|', 1) AS user_id, NULLIF(split_part(row_key, '|', 2), '3') AS shard, k, op AS _cdc_op, ts_ms AS _cdc_ts,
       seq AS _cdc_seq
FROM (SELECT * FROM ({CHANGES_SQL}) QUALIFY row_number() OVER (
  PARTITION BY split_part(row_key, '|', 1), NULLIF(split_part(row_key, '|', 2), '3') ORDER BY seq DESC) = 1)
WHERE op <> 'D'
""")
def apply_merge_replace(spark, sf_dir):
    """The batch repeats every third change the target has seen; the guard makes that harmless, also where a key part is null."""
    parts = F.split("row_key", r"\|")
    rows = _keyed(spark, sf_dir).select(parts[0].alias("user_id"), F.nullif(parts[1], F.lit("3")).alias("shard"), "k", "op", "ts_ms", "seq", "changed_at")
    keys = ["user_id", "shard"]
    target = apply.with_meta(apply.latest_change(_before(rows), keys))
    batch = _after(rows).unionByName(_before(rows).where(F.col("seq") % 3 == 0))
    return apply.merge_replace(target, batch, keys).select(*keys, *_STATE[1:])


@query("apply_merge_unguarded", f"""
WITH c AS (SELECT *, changed_at < TIMESTAMP '{HALF}' AS early FROM ({CHANGES_SQL})),
t AS (SELECT * FROM c WHERE early QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY seq DESC) = 1),
b AS (SELECT * FROM c WHERE NOT early OR seq % 3 = 0
      QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY op <> 'D' DESC, seq DESC) = 1)
SELECT COALESCE(b.row_key, t.row_key) AS row_key, CASE WHEN b.seq IS NULL THEN t.k ELSE b.k END AS k,
       COALESCE(b.op, t.op) AS _cdc_op, COALESCE(b.ts_ms, t.ts_ms) AS _cdc_ts, COALESCE(b.seq, t.seq) AS _cdc_seq
FROM (SELECT * FROM t WHERE op <> 'D') t FULL OUTER JOIN b ON t.row_key = b.row_key
WHERE COALESCE(b.op, t.op) <> 'D'
""")
def apply_merge_unguarded(spark, sf_dir):
    """Deletes of a batch before its upserts, and older changes overwrite newer rows."""
    rows = _keyed(spark, sf_dir)
    target = apply.with_meta(apply.current_state(_before(rows), ["row_key"]))
    batch = _after(rows).unionByName(_before(rows).where(F.col("seq") % 3 == 0))
    return apply.merge_replace(target, batch, ["row_key"], order="deletes_first", guard=False).select(*_STATE)


@query("apply_survivors_union", f"SELECT * FROM ({_STATE_SQL}) WHERE _cdc_op <> 'D'")
def apply_survivors_union(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    target = apply.with_meta(apply.current_state(_before(rows), ["row_key"]))
    return apply.survivors_and_upserts(target, _after(rows), ["row_key"]).select(*_STATE)


_PATCH_SQL = f"""
WITH c AS ({CHANGES_SQL}),
d AS (SELECT row_key, max(seq) AS deleted FROM c WHERE op = 'D' GROUP BY row_key),
e AS (SELECT row_key, event_type AS field, k AS value, seq, op, ts_ms FROM c WHERE op <> 'D'
      UNION ALL SELECT row_key, 'last' AS field, k AS value, seq, op, ts_ms FROM c WHERE op <> 'D'),
live AS (SELECT e.* FROM e LEFT JOIN d USING (row_key) WHERE e.seq > COALESCE(d.deleted, -1))
"""


@query("apply_merge_patch", f"""
{_PATCH_SQL}
SELECT row_key, field, value, _cdc_op, _cdc_ts, _cdc_seq
FROM (SELECT row_key, field, arg_max(value, seq) AS value FROM live GROUP BY row_key, field)
JOIN (SELECT row_key, arg_max(op, seq) AS _cdc_op, arg_max(ts_ms, seq) AS _cdc_ts, max(seq) AS _cdc_seq
      FROM live GROUP BY row_key) USING (row_key)
""")
def apply_merge_patch(spark, sf_dir):
    """A field per event type and the field ``last``; two batches, the second on top of the first."""
    after = F.when(F.col("op") != "D", F.create_map(F.col("event_type"), F.col("k"), F.lit("last"), F.col("k")))
    rows = changes(spark, sf_dir).withColumn("after", after)
    first = apply.fold_entries(apply.patch_entries(_before(rows), ["row_key"]), ["row_key"])
    documents = apply.documents_from_entries(apply.merge_patch(first, _after(rows), ["row_key"]), ["row_key"])
    return documents.select("row_key", F.explode("document").alias("field", "value"), META_OP, META_TS, META_SEQ)


@query("apply_counts", f"""
SELECT table_name, count(*) FILTER (WHERE op = 'I' AND seq % 23 <> 0) AS inserted,
       count(*) FILTER (WHERE op = 'U' AND seq % 23 <> 0) AS updated, count(*) FILTER (WHERE op = 'D') AS deleted,
       count(*) FILTER (WHERE op = 'D' OR seq % 23 <> 0) AS applied,
       count(*) FILTER (WHERE op <> 'D' AND seq % 23 = 0) AS skipped
FROM ({CHANGES_SQL}) GROUP BY table_name
""")
def apply_counts(spark, sf_dir):
    after = F.when((F.col("op") != "D") & (F.col("seq") % 23 != 0), F.col("k"))
    return apply.op_counts(changes(spark, sf_dir).withColumn("after", after), ["table_name"])


_ADVANCE_SQL = f"""
WITH c AS ({CHANGES_SQL}),
s AS (SELECT table_name AS config_id, max(seq) AS last_seq, count(*) AS n, max(changed_at) AS updated_at
      FROM c WHERE changed_at < TIMESTAMP '{HALF}' GROUP BY 1),
b AS (SELECT table_name AS config_id, max(seq) AS seq, count(*) AS n, max(changed_at) AS updated_at
      FROM c LEFT JOIN s ON s.config_id = c.table_name
      WHERE changed_at >= TIMESTAMP '{HALF}' AND table_name <> 'events_3' AND (s.last_seq IS NULL OR c.seq > s.last_seq)
      GROUP BY 1)
SELECT config_id, 'main' AS consumer_group, greatest(s.last_seq, b.seq) AS last_seq,
       COALESCE(s.n, 0) + COALESCE(b.n, 0) AS records_processed_total,
       CASE WHEN b.n IS NOT NULL THEN 'active' ELSE 'error' END AS status,
       epoch_us(greatest(s.updated_at, b.updated_at)) // 1000 AS updated_ms
FROM s FULL OUTER JOIN b USING (config_id)
"""


def _stream_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("table_name").alias("config_id")).agg(
        F.max("seq").alias("last_seq"), F.count("*").alias("records_processed_total"),
        F.max("changed_at").alias("updated_at"),
    ).select("config_id", F.lit("main").alias("consumer_group"), "last_seq", "records_processed_total",
             F.lit("error").alias("status"), "updated_at")


def _advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    state = _stream_state(rows.where(F.col("changed_at") < at(HALF)))
    batch = rows.where((F.col("changed_at") >= at(HALF)) & (F.col("table_name") != "events_3")).select(
        F.col("table_name").alias("config_id"), F.lit("main").alias("consumer_group"), "seq",
        F.col("changed_at").alias("at"))
    return status.advance_state(state, batch)


@query("stream_state_advance", _ADVANCE_SQL)
def stream_state_advance(spark, sf_dir):
    return _advanced(spark, sf_dir).withColumn("updated_ms", F.unix_millis("updated_at")).drop("updated_at")


@query("stream_state_offset", f"SELECT last_seq FROM ({_ADVANCE_SQL}) WHERE config_id = 'events_2'")
def stream_state_offset(spark, sf_dir):
    return status.last_offset(_advanced(spark, sf_dir), "events_2", "main")


@query("target_schema", """
SELECT event_type AS table_name, c AS column_name, 'BIGINT' AS source_type, 'bigint' AS target_type, count(*) AS seen
FROM (SELECT event_type, unnest(json_keys(props)) AS c FROM events) GROUP BY event_type, c
UNION ALL
SELECT event_type, m.c, 'META', m.t, count(*) FROM events,
  (VALUES ('_cdc_op', 'string'), ('_cdc_ts', 'bigint'), ('_cdc_seq', 'bigint')) m(c, t) GROUP BY event_type, m.c, m.t
""")
def target_schema_observed(spark, sf_dir):
    """Target columns of each event type, from the fields its payloads carry."""
    payload = load(spark, sf_dir, "events").select("event_type", F.try_parse_json("props").alias("v"))
    fields = payload.select("event_type", F.explode(F.expr("cast(v as map<string,variant>)")).alias("c", "x"))
    seen = fields.groupBy(
        F.col("event_type").alias("table_name"), F.col("c").alias("column_name"),
        F.schema_of_variant("x").alias("source_type")).agg(F.count("*").alias("seen"))
    kinds = F.create_map(*[F.lit(x) for name, kind in TARGET_TYPES.items() for x in (name, kind.simpleString())])
    target = F.coalesce(F.try_element_at(kinds, F.col("source_type")), F.lit("string"))
    columns = seen.select("table_name", "column_name", "source_type", target.alias("target_type"), "seen")
    meta = F.array(*[F.struct(F.lit(n).alias("c"), F.lit(t).alias("t")) for n, t in
                     ((META_OP, "string"), (META_TS, "bigint"), (META_SEQ, "bigint"))])
    tables = payload.groupBy(F.col("event_type").alias("table_name")).agg(F.count("*").alias("seen"))
    added = tables.select("table_name", F.explode(meta).alias("m"), "seen").select(
        "table_name", F.col("m.c").alias("column_name"), F.lit("META").alias("source_type"),
        F.col("m.t").alias("target_type"), "seen")
    return columns.unionByName(added)


@query("bulk_append", """
SELECT (o_orderkey - (SELECT min(o_orderkey) FROM orders)) // 1000 AS chunk_id,
       count(*) FILTER (WHERE o_totalprice <= 450000) AS records_written, count(*) FILTER (WHERE o_totalprice > 450000) AS records_failed
FROM orders GROUP BY 1
""")
def bulk_append(spark, sf_dir):
    """Orders whose price has more digits than the target column count as failed; the rest of their chunk is loaded."""
    rows = snapshot.with_chunk(load(spark, sf_dir, "orders"), "o_orderkey", 1000)
    return snapshot.bulk_append(rows, shared_dir(spark, "bulk"), failed=F.col("o_totalprice") > 450000)


_CHUNK_SQL = """
SELECT i AS chunk_id, lo + i * 1000 AS start_pk, least(lo + i * 1000 + 999, hi) AS end_pk, n AS chunks_total
FROM (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, (max(l_orderkey) - min(l_orderkey)) // 1000 + 1 AS n
      FROM lineitem) b, range(0, b.n) r(i)
"""


@query("chunk_plan", _CHUNK_SQL)
def chunk_plan(spark, sf_dir):
    return snapshot.chunk_plan(load(spark, sf_dir, "lineitem"), "l_orderkey", 1000)


@query("chunk_progress", f"""
WITH p AS ({_CHUNK_SQL}),
c AS (SELECT (l_orderkey - (SELECT min(l_orderkey) FROM lineitem)) // 1000 AS chunk_id, count(*) AS n
      FROM lineitem GROUP BY 1),
f AS (SELECT p.*, COALESCE(n, 0) AS rows_read FROM p LEFT JOIN c USING (chunk_id)),
g AS (SELECT *, (chunk_id + 1) * 1000 AS num FROM f)
SELECT chunk_id, rows_read, CAST(sum(rows_read) OVER (ORDER BY chunk_id) AS BIGINT) AS records_read,
       chunk_id + 1 AS chunks_completed, chunks_total, end_pk AS current_pk,
       CAST(num // chunks_total + CASE WHEN (num % chunks_total) * 2 > chunks_total
         OR ((num % chunks_total) * 2 = chunks_total AND (num // chunks_total) % 2 = 1) THEN 1 ELSE 0 END
         AS DOUBLE) / 10 AS percent
FROM g
""")
def chunk_progress(spark, sf_dir):
    return snapshot.load_progress(load(spark, sf_dir, "lineitem"), "l_orderkey", 1000)


@query("chunk_resume", """
SELECT chunk_id, count(*) AS rows_read, min(l_orderkey) AS first_pk, max(l_orderkey) AS last_pk,
       CAST(sum(l_linenumber) AS BIGINT) AS line_sum
FROM (SELECT *, (l_orderkey - (SELECT min(l_orderkey) FROM lineitem)) // 1000 AS chunk_id FROM lineitem)
WHERE chunk_id % 3 <> 0 GROUP BY chunk_id
""")
def chunk_resume(spark, sf_dir):
    """A load that goes on after every third chunk was already done."""
    table = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    done = snapshot.chunk_plan(table, "l_orderkey", 1000).where(F.col("chunk_id") % 3 == 0)
    rows = snapshot.chunk_read(table, "l_orderkey", 1000, done=done)
    return rows.groupBy("chunk_id").agg(
        F.count("*").alias("rows_read"), F.min("l_orderkey").alias("first_pk"), F.max("l_orderkey").alias("last_pk"),
        F.sum("l_linenumber").alias("line_sum"))


@query("snapshot_plus_log", """
WITH u AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, 'I' AS op, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS seq
  FROM customer
  UNION ALL
  SELECT user_id, CASE WHEN event_type <> 'error' THEN value END,
         CASE WHEN event_type <> 'error' THEN upper(event_type) END,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END, epoch_us(ts) // 1000, event_id + 1
  FROM events)
SELECT * FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1)
WHERE op <> 'D'
""")
def snapshot_plus_log(spark, sf_dir):
    """Customers as loaded, then the logged changes of the customers that events name."""
    loaded = snapshot.snapshot_as_changes(
        load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))
    kind = F.col("event_type")
    logged = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("c_custkey"),
        F.when(kind != "error", F.col("value")).alias("c_acctbal"),
        F.when(kind != "error", F.upper(kind)).alias("c_mktsegment"),
        F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U").alias("op"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        (F.col("event_id") + 1).alias("seq"))
    return apply.current_state(loaded.unionByName(logged), ["c_custkey"])


@query("reconcile_counts", """
WITH t AS (SELECT * REPLACE (CASE WHEN o_orderkey % 4999 = 0 THEN 'X' ELSE o_orderpriority END AS o_orderpriority)
           FROM orders WHERE NOT (o_orderkey % 97 = 0 AND o_orderstatus = 'P'))
SELECT o_orderstatus, a.n AS source_rows, b.n AS target_rows, a.n = b.n AND changed = 0 AS matches
FROM (SELECT NULLIF(o_orderstatus, 'F') AS o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4999 = 0) AS changed
      FROM orders GROUP BY 1) a
JOIN (SELECT NULLIF(o_orderstatus, 'F') AS status, count(*) AS n FROM t GROUP BY 1) b ON o_orderstatus IS NOT DISTINCT FROM status
""")
def reconcile_counts(spark, sf_dir):
    source = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    target = source.where(~((key % 97 == 0) & (F.col("o_orderstatus") == "P"))).withColumn(
        "o_orderpriority", F.when(key % 4999 == 0, F.lit("X")).otherwise(F.col("o_orderpriority")))
    source, target = (t.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F"))) for t in (source, target))
    return apply.reconcile(source, target, source.columns, ["o_orderstatus"])
