"""Report pages, catalog reports, schema differences, lineage and config checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.text import row_json
from changeflow.functions.times import iso_text
from changeflow.operators import catalog, reports, status
from changeflow.plans.inputs import at, load, samples
from changeflow.plans.registry import query
from changeflow.sources import catalog as catalog_source

_AUDIT_SQL = """
SELECT event_id, ts, event_type AS entity_type, 'e' || (user_id % 20) AS entity_id,
       CASE event_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' WHEN 2 THEN 'deleted' END AS action,
       user_id, props
FROM events
"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("entity_type"),
        F.concat(F.lit("e"), (F.col("user_id") % 20).cast("string")).alias("entity_id"),
        F.when(kind == 0, "created").when(kind == 1, "updated").when(kind == 2, "deleted").alias("action"),
        "user_id", "props")


@query("log_page", f"""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, entity_type, entity_id, action FROM ({_AUDIT_SQL})
WHERE entity_type = 'purchase' AND action = 'updated' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100
""")
def log_page(spark, sf_dir):
    rows = reports.maybe_where(_audit(spark, sf_dir), entity_type="purchase", entity_id=None, action="updated")
    return reports.page(rows, "ts", "event_id", limit=50, offset=100).select(
        "event_id", iso_text(F.col("ts")).alias("at"), "entity_type", "entity_id", "action")


@query("log_page_after", f"""
WITH r AS (SELECT * FROM ({_AUDIT_SQL}) WHERE entity_type = 'purchase' AND action = 'updated'),
l AS (SELECT ts, event_id FROM r ORDER BY ts DESC, event_id DESC LIMIT 1 OFFSET 99)
SELECT r.event_id, strftime(r.ts, '%Y-%m-%dT%H:%M:%S') AS at, r.entity_type, r.entity_id, r.action FROM r, l
WHERE r.ts < l.ts OR (r.ts = l.ts AND r.event_id < l.event_id) ORDER BY r.ts DESC, r.event_id DESC LIMIT 50
""")
def log_page_after(spark, sf_dir):
    """The page after the row that a first page of 100 ended with."""
    rows = reports.maybe_where(_audit(spark, sf_dir), entity_type="purchase", entity_id=None, action="updated")
    shown = reports.page(rows, "ts", "event_id", limit=100).select("ts", "event_id")
    ended = shown.orderBy("ts", "event_id").first()
    last = (ended["ts"], ended["event_id"]) if ended else (None, 0)
    return reports.page_after(rows, "ts", "event_id", last, limit=50).select(
        "event_id", iso_text(F.col("ts")).alias("at"), "entity_type", "entity_id", "action")


@query("log_total", f"SELECT count(*) AS total FROM ({_AUDIT_SQL}) WHERE entity_type = 'purchase' AND action = 'updated'")
def log_total(spark, sf_dir):
    return reports.total(reports.maybe_where(_audit(spark, sf_dir), entity_type="purchase", action="updated"))


@query("log_actions", f"SELECT DISTINCT action FROM ({_AUDIT_SQL}) WHERE action IS NOT NULL")
def log_actions(spark, sf_dir):
    return reports.distinct_values(_audit(spark, sf_dir), "action")


@query("log_search", f"""
SELECT event_id, entity_type, entity_id, action FROM ({_AUDIT_SQL})
WHERE contains(lower(to_json({{'event_id': event_id, 'entity_type': entity_type, 'entity_id': entity_id,
                              'action': action}})), lower('E7","ACTION":null'))
""")
def log_search(spark, sf_dir):
    rows = _audit(spark, sf_dir).select("event_id", "entity_type", "entity_id", "action")
    return reports.search(rows, 'E7","ACTION":null')


@query("log_preview", """
SELECT doc_id, left(lang || '-' || source, 8) AS short_id, left('{"doc_id":' || doc_id || ',"lang":"' || lang ||
       '","source":"' || source || '","n_chars":' || n_chars || ',"quality":' || COALESCE(CAST(quality AS VARCHAR),
       'null') || ',"toxic":' || COALESCE(CAST(toxic AS VARCHAR), 'null') || '}', 120) AS preview
FROM documents LEFT JOIN labels USING (doc_id)
""")
def log_preview(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(
        load(spark, sf_dir, "labels"), "doc_id", "left")
    columns = [F.col(c) for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")]
    return documents.select(
        "doc_id", F.left(F.concat_ws("-", "lang", "source"), F.lit(8)).alias("short_id"),
        reports.preview(row_json(*columns), 120).alias("preview"))


@query("report_newest", f"SELECT event_id, entity_type FROM ({_AUDIT_SQL}) ORDER BY ts DESC, event_id DESC LIMIT 100")
def report_newest(spark, sf_dir):
    return reports.newest(_audit(spark, sf_dir), "ts", "event_id", 100).select("event_id", "entity_type")


@query("report_chart", f"""
SELECT event_id, value_ms FROM (SELECT event_id, ts, (event_id * 7919) % 60000 AS value_ms FROM events
                                WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 30)
""")
def report_chart(spark, sf_dir):
    rows = samples(spark, sf_dir).where(F.col("event_type") == "view")
    return reports.newest_in_order(rows, "ts", "event_id", 30).select("event_id", F.col("latency_ms").alias("value_ms"))


@query("violations_by_config", """
SELECT c_custkey AS config_id, c_name AS name, count(o_orderkey) AS large_orders
FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000 AND c_mktsegment = 'BUILDING'
GROUP BY ALL
""")
def violations_by_config(spark, sf_dir):
    """Rows of one config: orders are counted per customer before they meet the customers."""
    large = load(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000).groupBy(
        F.col("o_custkey").alias("config_id")).agg(F.count("*").alias("large_orders"))
    configs = reports.maybe_where(load(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=None)
    return configs.select(F.col("c_custkey").alias("config_id"), F.col("c_name").alias("name")).join(large, "config_id")


# A catalog with one table per order and one column per order line.
_TABLES_SQL = """
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'SYS' WHEN 1 THEN 'XSYS_A' WHEN 2 THEN 'Sales' ELSE 'OPS' END AS schema_name,
       replace(o_orderpriority, ' ', '_') || '_' || o_orderkey AS table_name, o_orderkey AS record_count
FROM orders
"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    name = F.concat_ws("_", F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_")),
                       F.col("o_orderkey").cast("string"))
    return load(spark, sf_dir, "orders").select(
        F.when(kind == 0, "SYS").when(kind == 1, "XSYS_A").when(kind == 2, "Sales").otherwise("OPS").alias(
            "schema_name"),
        name.alias("table_name"), F.col("o_orderkey").alias("record_count"), "o_orderdate")


@query("table_search", f"""
SELECT * FROM ({_TABLES_SQL}) WHERE schema_name NOT LIKE 'SYS%' AND schema_name NOT LIKE '_SYS%'
  AND contains(upper(table_name), upper('urgent_1'))
""")
def table_search(spark, sf_dir):
    return catalog.search_tables(_tables(spark, sf_dir), "urgent_1").select("schema_name", "table_name", "record_count")


@query("tables_per_schema", f"""
SELECT schema_name, count(*) AS tables, CAST(sum(record_count) AS BIGINT) AS records FROM ({_TABLES_SQL})
WHERE schema_name NOT LIKE 'SYS%' AND schema_name NOT LIKE '_SYS%' GROUP BY schema_name
""")
def tables_per_schema(spark, sf_dir):
    return catalog.tables_per_schema(catalog.search_tables(_tables(spark, sf_dir)))


@query("catalog_fresh", f"""
SELECT table_name FROM (SELECT t.table_name, o_orderdate + INTERVAL 24 HOUR AS expires_at
  FROM ({_TABLES_SQL}) t JOIN orders ON record_count = o_orderkey) WHERE expires_at > TIMESTAMP '2000-01-01'
""")
def catalog_fresh(spark, sf_dir):
    expires = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 24 HOURS")
    cache = _tables(spark, sf_dir).withColumn("expires_at", expires)
    return catalog.fresh(cache, at("2000-01-01")).select("table_name")


# Lines that share an order and a number make one column.
_FIELDS_SQL = """
SELECT l_orderkey AS config_id, 'C' || l_linenumber AS column_name, l_linenumber AS position,
       CASE WHEN max(l_returnflag) = 'A' THEN 'VARCHAR' WHEN max(l_returnflag) = 'N' THEN 'BIGINT' ELSE 'DOUBLE' END
         AS data_type,
       min(l_partkey) AS p, min(l_suppkey) AS s, min(l_linestatus) = 'F' AS keyed
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("config_id"), "l_linenumber").agg(
        F.max("l_returnflag").alias("flag"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"),
        (F.min("l_linestatus") == "F").alias("keyed"))
    kind = F.when(F.col("flag") == "A", "VARCHAR").when(F.col("flag") == "N", "BIGINT").otherwise("DOUBLE")
    return lines.select(
        "config_id", F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("column_name"),
        F.col("l_linenumber").alias("position"), kind.alias("data_type"), "p", "s", "keyed")


_SCANNED = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "customer": ["c_custkey"]}


@query("catalog_scan", " UNION ALL ".join(
    f"SELECT 'shop' AS schema_name, table_name, 'TABLE' AS table_type, column_name, column_index - 1 AS position, data_type, is_nullable, "
    f"list_contains({keys}, column_name) AS is_primary_key, (SELECT count(*) FROM {name}) AS record_count "
    f"FROM duckdb_columns() WHERE table_name = '{name}'" for name, keys in _SCANNED.items()))
def catalog_scan(spark, sf_dir):
    """Columns of the given tables as a catalog lists them, beside the tables' row counts."""
    tables = {name: load(spark, sf_dir, name) for name in _SCANNED}
    fields = catalog_source.field_rows(spark, "shop", tables, _SCANNED)
    return fields.join(catalog_source.table_counts(tables, "shop"), ["schema_name", "table_name"])


@query("catalog_fields", f"""
SELECT config_id, column_name, position, data_type, keyed AND position < 4 AS is_primary_key FROM ({_FIELDS_SQL})
""")
def catalog_fields(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    keys = fields.where(F.col("keyed") & (F.col("position") < 4)).select("config_id", "column_name")
    return catalog.fields_with_keys(fields, keys, ["config_id"]).select(
        "config_id", "column_name", "position", "data_type", "is_primary_key")


_KNOWN_SQL = f"""
SELECT config_id, column_name, CASE WHEN p % 5 = 0 THEN 'VARCHAR' WHEN p % 5 < 4 THEN data_type END AS data_type,
       s % 13 = 0 AS is_primary_key FROM ({_FIELDS_SQL}) WHERE s % 9 <> 0
"""
_NOW_SQL = f"""
SELECT config_id, column_name, data_type, s % 13 = 0 OR p % 17 = 0 AS is_primary_key
FROM ({_FIELDS_SQL}) WHERE p % 7 <> 0
"""
_CHANGES_SQL = f"""
WITH b AS (
  SELECT COALESCE(k.config_id, n.config_id) AS config_id, COALESCE(k.column_name, n.column_name) AS column_name,
         k.data_type AS old_type, n.data_type AS new_type, k.config_id IS NULL AS added, n.config_id IS NULL AS removed,
         k.is_primary_key AS old_pk, n.is_primary_key AS new_pk
  FROM ({_KNOWN_SQL}) k FULL OUTER JOIN ({_NOW_SQL}) n ON k.config_id = n.config_id AND k.column_name = n.column_name)
SELECT config_id, column_name, 'column_added' AS change_type, old_type, new_type, 'pending' AS status FROM b WHERE added
UNION ALL SELECT config_id, column_name, 'column_removed', old_type, new_type, 'pending' FROM b WHERE removed
UNION ALL SELECT config_id, column_name, 'type_changed', old_type, new_type, 'pending' FROM b WHERE old_type <> new_type
UNION ALL SELECT config_id, column_name, 'pk_changed', old_type, new_type, 'pending' FROM b WHERE old_pk <> new_pk
"""


def _schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _fields(spark, sf_dir)
    digit = F.col("p") % 5
    known = fields.where(F.col("s") % 9 != 0).select(
        "config_id", "column_name", F.when(digit == 0, "VARCHAR").when(digit < 4, F.col("data_type")).alias(
            "data_type"), (F.col("s") % 13 == 0).alias("is_primary_key"))
    found = fields.where(F.col("p") % 7 != 0).select(
        "config_id", "column_name", "data_type",
        ((F.col("s") % 13 == 0) | (F.col("p") % 17 == 0)).alias("is_primary_key"))
    return catalog.schema_changes(known, found)


@query("schema_diff", _CHANGES_SQL)
def schema_diff(spark, sf_dir):
    return _schema_changes(spark, sf_dir)


@query("schema_resolve", f"""
SELECT change_type, CASE WHEN change_type = 'column_added' THEN 'applied' ELSE 'pending' END AS status,
       change_type = 'column_added' AS auto_resolved, count(*) AS changes
FROM ({_CHANGES_SQL}) GROUP BY ALL
""")
def schema_resolve(spark, sf_dir):
    return catalog.resolve_added(_schema_changes(spark, sf_dir)).groupBy("change_type", "status", "auto_resolved").agg(
        F.count("*").alias("changes"))


@query("schema_pending", f"""
SELECT config_id, column_name, change_type FROM ({_CHANGES_SQL}) WHERE change_type <> 'column_added'
ORDER BY config_id DESC, column_name DESC, change_type DESC LIMIT 100
""")
def schema_pending(spark, sf_dir):
    """The 100 newest changes still waiting; a higher config id counts as newer."""
    resolved = catalog.resolve_added(_schema_changes(spark, sf_dir))
    pending = reports.maybe_where(resolved, status="pending").withColumn(
        "tie", F.concat_ws("/", "column_name", "change_type"))
    return reports.newest(pending, "config_id", "tie", 100).select("config_id", "column_name", "change_type")


_CONFIGS_SQL = f"""
SELECT config_id, CAST(config_id % 150 AS BIGINT) AS connector_id,
       list(column_name ORDER BY column_name) FILTER (WHERE p % 7 <> 0) AS sources,
       CASE WHEN config_id % 2 = 0 THEN ['C1'] ELSE ['C1', 'C2'] END AS keys
FROM ({_FIELDS_SQL}) GROUP BY config_id
"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs with a mapping list; a table is as wide as its order has line numbers."""
    mapping = F.struct(F.col("column_name").alias("source"), F.lower("column_name").alias("target"),
                       F.lit(None).cast("string").alias("transform"))
    lists = _fields(spark, sf_dir).groupBy("config_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("p") % 7 != 0, mapping))).alias("field_mappings"))
    keys = F.when(F.col("config_id") % 2 == 0, F.array(F.lit("C1"))).otherwise(F.array(F.lit("C1"), F.lit("C2")))
    return lists.withColumn("connector_id", F.col("config_id") % 150).withColumn("primary_key_fields", keys)


@query("config_check", f"""
WITH c AS (SELECT *, connector_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) AS found,
                  COALESCE(len(sources), 0) > 0 AS mapped,
                  list_has_all(COALESCE(sources, []), keys) AS keyed FROM ({_CONFIGS_SQL}))
SELECT config_id, found AS connector_exists, mapped AS field_mappings_present, keyed AS pk_in_mappings,
       found AND mapped AS valid FROM c
""")
def config_check(spark, sf_dir):
    connectors = load(spark, sf_dir, "supplier").where(F.col("s_nationkey") < 20).select(
        F.col("s_suppkey").alias("connector_id"))
    return catalog.check_configs(_configs(spark, sf_dir), connectors)


@query("auto_map", f"""
SELECT config_id, source, lower(source) AS target, i - 1 AS place FROM (
  SELECT config_id, unnest(all_sources) AS source, generate_subscripts(all_sources, 1) AS i FROM (
    SELECT c.config_id, list_concat(COALESCE(sources, []), COALESCE(added, [])) AS all_sources
    FROM ({_CONFIGS_SQL}) c LEFT JOIN (
      SELECT config_id, list(column_name ORDER BY column_name) AS added FROM ({_CHANGES_SQL})
      WHERE change_type = 'column_added' GROUP BY config_id) a USING (config_id)))
""")
def auto_map(spark, sf_dir):
    """Configs with their added columns appended to the mapping list."""
    new = catalog.auto_map(_schema_changes(spark, sf_dir))
    grown = catalog.extend_mappings(_configs(spark, sf_dir), new)
    return grown.select("config_id", F.posexplode("field_mappings").alias("place", "m")).select(
        "config_id", "m.source", "m.target", "place")


_TRANSFORMS_SQL = f"""
SELECT config_id, column_name AS source_field, 'mask' AS transform_type, 'email' AS params, 10 AS execution_order,
       p % 3 = 0 AS is_enabled FROM ({_FIELDS_SQL}) WHERE s % 2 = 0
UNION ALL SELECT config_id, column_name, 'hash', 'md5', 5, TRUE FROM ({_FIELDS_SQL}) WHERE s % 3 = 0
"""
_LINEAGE_SQL = f"""
SELECT m.config_id, m.source, lower(m.source) AS target, COALESCE(chain, '') AS chain, COALESCE(masked, FALSE) AS masked
FROM (SELECT config_id, column_name AS source FROM ({_FIELDS_SQL}) WHERE p % 7 <> 0) m
LEFT JOIN (SELECT config_id, source_field AS source,
                  string_agg(transform_type || ':' || params, '>' ORDER BY execution_order) AS chain,
                  bool_or(transform_type = 'mask') AS masked
           FROM ({_TRANSFORMS_SQL}) WHERE is_enabled GROUP BY 1, 2) t
  ON m.config_id = t.config_id AND m.source = t.source
"""


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _fields(spark, sf_dir)
    mappings = fields.where(F.col("p") % 7 != 0).select(
        "config_id", F.col("column_name").alias("source"), F.lower("column_name").alias("target"))
    field = F.col("column_name").alias("source_field")

    def step(kind: str, params: str, order: int, enabled) -> list:
        return [F.lit(kind).alias("transform_type"), F.lit(params).alias("transform_params"),
                F.lit(order).alias("execution_order"), enabled.alias("is_enabled")]

    masks = fields.where(F.col("s") % 2 == 0).select("config_id", field, *step("mask", "email", 10, F.col("p") % 3 == 0))
    hashes = fields.where(F.col("s") % 3 == 0).select("config_id", field, *step("hash", "md5", 5, F.lit(True)))
    return catalog.column_lineage(mappings, masks.unionByName(hashes))


@query("lineage", _LINEAGE_SQL)
def lineage(spark, sf_dir):
    steps = F.transform("transformations", lambda t: F.concat_ws(":", t["type"], t["params"]))
    return _lineage(spark, sf_dir).select(
        "config_id", "source", "target", F.array_join(steps, ">").alias("chain"), F.col("masking_applied").alias("masked"))


@query("lineage_per_table", f"SELECT config_id, count(*) AS columns FROM ({_LINEAGE_SQL}) GROUP BY config_id")
def lineage_per_table(spark, sf_dir):
    return catalog.lineage_columns_per_table(_lineage(spark, sf_dir), ["config_id"])


@query("fk_check", """
SELECT 'orders' AS parent, l_orderkey AS key_value, count(*) AS child_rows FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL
UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) GROUP BY ALL
UNION ALL SELECT 'supplier', l_suppkey, count(*) FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL
""")
def fk_check(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    parents = {
        "orders": ("l_orderkey", load(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P"), "o_orderkey"),
        "part": ("l_partkey", load(spark, sf_dir, "part").where(F.col("p_size") < 45), "p_partkey"),
        "supplier": ("l_suppkey", load(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0), "s_suppkey"),
    }
    return catalog.all_orphans(lines, parents)


_CONFIG_ROWS_SQL = """
SELECT c_custkey AS config_id, 'cdc.' || lower(c_mktsegment) || '.' || lower(c_name) AS kafka_topic,
       c_custkey % 5 > 0 AS is_enabled, c_custkey % 7 > 0 AS trigger_deployed,
       CASE WHEN c_custkey % 3 = 0 THEN 'batch' ELSE 'cdc' END AS replication_mode
FROM customer
"""


def _config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        key.alias("config_id"),
        F.concat_ws(".", F.lit("cdc"), F.lower("c_mktsegment"), F.lower("c_name")).alias("kafka_topic"),
        (key % 5 > 0).alias("is_enabled"), (key % 7 > 0).alias("trigger_deployed"),
        F.when(key % 3 == 0, "batch").otherwise("cdc").alias("replication_mode"))


@query("active_configs", f"""
SELECT config_id, kafka_topic FROM ({_CONFIG_ROWS_SQL})
WHERE is_enabled AND trigger_deployed AND replication_mode = 'cdc'
""")
def active_configs(spark, sf_dir):
    return status.active_configs(_config_rows(spark, sf_dir)).select("config_id", "kafka_topic")


_STATE_SQL = """
SELECT user_id AS config_id, event_id AS last_seq, event_type, ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("config_id"), F.col("event_id").alias("last_seq"), "event_type",
        F.col("ts").cast("timestamp").alias("updated_at"))
    return status.latest_by(rows, ["config_id"], ["updated_at", "last_seq"])


@query("latest_state", f"SELECT config_id, last_seq, event_type FROM ({_STATE_SQL})")
def latest_state(spark, sf_dir):
    return _state(spark, sf_dir).select("config_id", "last_seq", "event_type")


@query("stream_lookup", f"""
SELECT s.config_id, last_seq, COALESCE(kafka_topic, 'unknown') AS topic
FROM ({_STATE_SQL}) s LEFT JOIN (SELECT * FROM ({_CONFIG_ROWS_SQL}) WHERE replication_mode = 'cdc') c USING (config_id)
""")
def stream_lookup(spark, sf_dir):
    configs = reports.maybe_where(_config_rows(spark, sf_dir), replication_mode="cdc")
    return status.stream_lag_view(_state(spark, sf_dir), configs).select("config_id", "last_seq", "topic")


_COMMANDS_SQL = """
SELECT event_id AS command_id, user_id AS config_id, ts AS issued_at,
       CASE event_type WHEN 'error' THEN 'pause' WHEN 'signup' THEN 'resume' WHEN 'view' THEN 'restart'
            WHEN 'click' THEN 'pause' ELSE 'reload' END AS command
FROM events
"""


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("command_id"), F.col("user_id").alias("config_id"),
        F.col("ts").cast("timestamp").alias("issued_at"),
        F.when(kind.isin("error", "click"), "pause").when(kind == "signup", "resume").when(
            kind == "view", "restart").otherwise("reload").alias("command"))


@query("paused_filter", f"""
SELECT event_id, user_id AS config_id FROM events WHERE user_id NOT IN (
  SELECT config_id FROM (SELECT config_id, arg_max(command, command_id) AS last FROM ({_COMMANDS_SQL})
                         WHERE command <> 'reload' GROUP BY 1) WHERE last = 'pause')
""")
def paused_filter(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("config_id"))
    return status.without_paused(rows, _commands(spark, sf_dir)).select("event_id", "config_id")


@query("start_positions", f"""
SELECT s.config_id, CASE WHEN r.at >= s.at THEN 0 ELSE s.last_seq END AS last_seq
FROM (SELECT user_id AS config_id, max(event_id) AS last_seq, max(ts) AS at FROM events
      WHERE event_type IN ('purchase', 'view') GROUP BY 1) s
LEFT JOIN (SELECT config_id, max(issued_at) AS at FROM ({_COMMANDS_SQL}) WHERE command = 'restart' GROUP BY 1) r
  USING (config_id)
""")
def start_positions(spark, sf_dir):
    """State is written on purchases and views; views are also restarts."""
    state = load(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view")).select(
        F.col("user_id").alias("config_id"), F.col("event_id").alias("last_seq"),
        F.col("ts").cast("timestamp").alias("updated_at"))
    return status.start_positions(state, _commands(spark, sf_dir))


@query("stream_metrics", f"""
SELECT config_id, event_type AS target_type, event_id FROM (
  SELECT user_id AS config_id, event_type, event_id, ts FROM events
  WHERE user_id IN (SELECT config_id FROM ({_STATE_SQL}) WHERE event_type = 'purchase'))
ORDER BY ts DESC, config_id, target_type, event_id LIMIT 100
""")
def stream_metrics(spark, sf_dir):
    metrics = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("config_id"), F.col("event_type").alias("target_type"), "event_id",
        F.col("ts").alias("window_end"))
    state = reports.maybe_where(_state(spark, sf_dir), event_type="purchase")
    return status.stream_metrics(state, metrics, 100).select("config_id", "target_type", "event_id")
