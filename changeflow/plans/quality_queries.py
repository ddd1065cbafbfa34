"""Quality rules, routing and violation reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import quality, status
from changeflow.operators.transform import map_columns
from changeflow.plans.inputs import CHANGES_SQL, changes, load
from changeflow.plans.registry import query
from changeflow.schemas import Mapping, Rule, Transform
from changeflow.sources import metadata
from changeflow.streaming import pipeline

ORDER_RULES = [
    Rule("r1", "o_totalprice", "range", {"min": 10000, "max": 400000}, "warn"),
    Rule("r2", "o_orderstatus", "enum", {"values": ["O", "F"]}, "reject"),
    Rule("r3", "o_orderpriority", "regex", {"pattern": r"\d-[A-Z]+$"}, "quarantine"),
    Rule("r4", "o_custkey", "not_null", {}, "reject"),
    Rule("r5", "o_orderpriority", "length", {"min": 6, "max": 14}, "warn"),
    Rule("r6", "o_orderpriority", "range", {"max": 3}, "reject"),
    Rule("r7", "o_totalprice", "not_null", {}, "reject", is_enabled=False),
]

# Orders of every 50th customer key lose the key, as a not_null case.
_ORDERS_SQL = "SELECT * REPLACE (CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS o_custkey) FROM orders"

_VIOLATIONS_SQL = f"""
WITH o AS ({_ORDERS_SQL}),
v AS (
  SELECT 'r1' AS rule_id, 'o_totalprice' AS field_name, CAST(o_totalprice AS VARCHAR) AS field_value, o_orderkey,
    'range' AS violation_type, 'warn' AS severity, 'value ' || CAST(o_totalprice AS VARCHAR) ||
    CASE WHEN o_totalprice < 10000 THEN ' below minimum 10000' ELSE ' above maximum 400000' END AS problem
  FROM o WHERE o_totalprice < 10000 OR o_totalprice > 400000
  UNION ALL SELECT 'r2', 'o_orderstatus', o_orderstatus, o_orderkey, 'enum', 'reject',
    'value ''' || o_orderstatus || ''' not in allowed set' FROM o WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT 'r3', 'o_orderpriority', o_orderpriority, o_orderkey, 'regex', 'quarantine',
    'doesn''t match pattern ''\\d-[A-Z]+$''' FROM o WHERE NOT regexp_matches(o_orderpriority, '^(?:\\d-[A-Z]+$)')
  UNION ALL SELECT 'r4', 'o_custkey', NULL, o_orderkey, 'not_null', 'reject', 'is null' FROM o WHERE o_custkey IS NULL
  UNION ALL SELECT 'r5', 'o_orderpriority', o_orderpriority, o_orderkey, 'length', 'warn',
    'length ' || length(o_orderpriority) ||
    CASE WHEN length(o_orderpriority) < 6 THEN ' below minimum 6' ELSE ' above maximum 14' END
  FROM o WHERE length(o_orderpriority) < 6 OR length(o_orderpriority) > 14)
SELECT rule_id, 'orders' AS config_id, field_name, field_value, CAST(o_orderkey AS VARCHAR) AS row_key, violation_type,
       severity, 'Field ''' || field_name || ''' ' || problem AS message, o_orderkey AS event_seq
FROM v
"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    custkey = F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey"))
    orders = load(spark, sf_dir, "orders").withColumn("o_custkey", custkey)
    return quality.validate(orders, ORDER_RULES, F.col("o_orderkey").cast("string"), F.col("o_orderkey"), "orders")


@query("quality_violations", _VIOLATIONS_SQL)
def quality_violations(spark, sf_dir):
    return quality.violation_rows(_validated(spark, sf_dir))


_ROUTES_SQL = f"""
SELECT o.o_orderkey, COALESCE(n, 0) AS violations,
       CASE WHEN COALESCE(rejects, 0) > 0 THEN 'reject' {{quarantine}} ELSE 'pass' END AS route
FROM orders o LEFT JOIN (
  SELECT event_seq, count(*) AS n, count(*) FILTER (WHERE severity = 'reject') AS rejects,
         count(*) FILTER (WHERE severity = 'quarantine') AS quarantines
  FROM ({_VIOLATIONS_SQL}) GROUP BY 1) v ON o.o_orderkey = v.event_seq
"""


@query("quality_routes", _ROUTES_SQL.format(quarantine="WHEN COALESCE(quarantines, 0) > 0 THEN 'quarantine'"))
def quality_routes(spark, sf_dir):
    return quality.with_route(_validated(spark, sf_dir)).select(
        "o_orderkey", F.size("violations").alias("violations"), "route")


@query("quality_routes_reject_only", _ROUTES_SQL.format(quarantine=""))
def quality_routes_reject_only(spark, sf_dir):
    return quality.with_route(_validated(spark, sf_dir), quarantine_blocks=False).select(
        "o_orderkey", F.size("violations").alias("violations"), "route")


LINE_RULES = [
    Rule("c1", "l_discount", "custom_sql", {"expr": "l_discount <= l_tax * 2"}, "warn"),
    Rule("c2", "l_shipdate", "custom_sql", {"expr": "l_shipdate >= timestamp_ntz'1996-01-01'"}, "reject"),
    Rule("c3", "l_tax", "custom_sql", {"expr": "nullif(l_tax, 0) < 0.07"}, "warn"),
]


@query("quality_custom", """
SELECT rule_id, row_key, severity, message, count(*) AS violations FROM (
  SELECT 'c1' AS rule_id, l_orderkey || '|' || l_linenumber AS row_key, 'warn' AS severity,
         'Field ''l_discount'' fails condition l_discount <= l_tax * 2' AS message
  FROM lineitem WHERE NOT (l_discount <= l_tax * 2)
  UNION ALL SELECT 'c2', l_orderkey || '|' || l_linenumber, 'reject',
         'Field ''l_shipdate'' fails condition l_shipdate >= timestamp_ntz''1996-01-01'''
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '1996-01-01')
  UNION ALL SELECT 'c3', l_orderkey || '|' || l_linenumber, 'warn',
         'Field ''l_tax'' fails condition nullif(l_tax, 0) < 0.07'
  FROM lineitem WHERE NOT (nullif(l_tax, 0) < 0.07::DOUBLE)) GROUP BY ALL
""")
def quality_custom(spark, sf_dir):
    key = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = quality.validate(load(spark, sf_dir, "lineitem"), LINE_RULES, key, F.col("l_orderkey"))
    return quality.violation_rows(rows).groupBy("rule_id", "row_key", "severity", "message").agg(
        F.count("*").alias("violations"))


DOCUMENT_RULES = [
    Rule("d1", "text", "length", {"min": 200, "max": 5000}, "warn"),
    Rule("d2", "text", "regex", {"pattern": r"\p{Lu}"}, "reject"),
    Rule("d3", "lang", "enum", {"values": ["en", "fr", "de"]}, "quarantine"),
    Rule("d4", "quality", "not_null", {}, "warn"),
]


@query("quality_documents", """
WITH d AS (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (
  SELECT doc_id, 'd1' AS rule_id, 'text' AS f, '***REDACTED***' AS field_value, 'fails length' AS problem
  FROM d WHERE length(text) < 200 OR length(text) > 5000
  UNION ALL SELECT doc_id, 'd2', 'text', '***REDACTED***', 'fails regex'
  FROM d WHERE NOT regexp_matches(text, '^(?:\\p{Lu})')
  UNION ALL SELECT doc_id, 'd3', 'lang', lang, 'value ''' || lang || ''' not in allowed set'
  FROM d WHERE lang NOT IN ('en', 'fr', 'de')
  UNION ALL SELECT doc_id, 'd4', 'quality', NULL, 'is null' FROM d WHERE quality IS NULL)
SELECT rule_id, f AS field_name, field_value, 'Field ''' || f || ''' ' || problem AS message, doc_id AS event_seq FROM v
""")
def quality_documents(spark, sf_dir):
    """Rules over whole texts. The text has a masking chain, so violations do not quote it."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    documents = load(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    rows = quality.validate(
        documents, DOCUMENT_RULES, F.col("doc_id").cast("string"), F.col("doc_id"),
        masks=[Transform("text", "mask", {"mask_type": "full"})])
    return quality.violation_rows(rows).select("rule_id", "field_name", "field_value", "message", "event_seq")


# One rule per customer, by key: range, enum, length, regex or not_null on a field of its orders.
_RULES_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS config_id, 'rule' || c_custkey AS rule_id, c_custkey % 5 AS kind,
       CASE c_custkey % 5 WHEN 0 THEN 'total' WHEN 1 THEN 'status' WHEN 2 THEN 'priority' WHEN 3 THEN 'priority'
            ELSE 'note' END AS field_name,
       CASE WHEN c_acctbal < 2000 THEN 'reject' ELSE 'warn' END AS severity, c_custkey % 7 <> 0 AS is_enabled,
       CAST(floor(c_acctbal) AS BIGINT) * 20 AS low
FROM customer
"""

_TENANT_SQL = f"""
SELECT r.rule_id, r.config_id, r.field_name,
       CASE kind WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN o_orderstatus WHEN 4 THEN NULL
                 ELSE o_orderpriority END AS field_value,
       CAST(o_orderkey AS VARCHAR) AS row_key,
       CASE kind WHEN 0 THEN 'range' WHEN 1 THEN 'enum' WHEN 2 THEN 'length' WHEN 3 THEN 'regex' ELSE 'not_null' END
         AS violation_type,
       severity,
       'Field ''' || field_name || ''' ' || CASE kind
         WHEN 0 THEN 'value ' || CAST(o_totalprice AS VARCHAR) ||
           CASE WHEN o_totalprice < low THEN ' below minimum ' || low ELSE ' above maximum ' || (low + 100000) END
         WHEN 1 THEN 'value ''' || o_orderstatus || ''' not in allowed set'
         WHEN 2 THEN 'length ' || length(o_orderpriority) ||
           CASE WHEN length(o_orderpriority) < 6 THEN ' below minimum 6' ELSE ' above maximum 8' END
         WHEN 3 THEN 'doesn''t match pattern ''[12]-''' ELSE 'is null' END AS message,
       o_orderkey AS event_seq
FROM orders o JOIN ({_RULES_SQL}) r ON r.config_id = CAST(o.o_custkey AS VARCHAR)
WHERE is_enabled AND CASE kind
  WHEN 0 THEN o_totalprice < low OR o_totalprice > low + 100000
  WHEN 1 THEN o_orderstatus NOT IN ('O', 'P')
  WHEN 2 THEN length(o_orderpriority) < 6 OR length(o_orderpriority) > 8
  WHEN 3 THEN NOT regexp_matches(o_orderpriority, '^(?:[12]-)')
  ELSE TRUE END
"""


def _tenant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 5

    def pick(*values):
        result = F.when(kind == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            result = result.when(kind == i, value)
        return result

    low = F.floor("c_acctbal") * 20
    limits = F.format_string('{"min": %d, "max": %d}', low, low + 100000)
    return load(spark, sf_dir, "customer").select(
        F.concat(F.lit("rule"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_custkey").cast("string").alias("config_id"),
        pick(*map(F.lit, ("total", "status", "priority", "priority", "note"))).alias("field_name"),
        pick(*map(F.lit, ("range", "enum", "length", "regex", "not_null"))).alias("rule_type"),
        F.when(F.col("c_acctbal") < 2000, "reject").otherwise("warn").alias("severity"),
        (F.col("c_custkey") % 7 != 0).alias("is_enabled"),
        pick(limits, F.lit('{"values": ["O", "P"]}'), F.lit('{"min": 6, "max": 8}'), F.lit('{"pattern": "[12]-"}'),
             F.lit("{}")).alias("rule_params"),
    )


def _tenant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.create_map(
        F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"),
        F.lit("priority"), F.col("o_orderpriority"))
    events = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("config_id"), F.col("o_orderkey").cast("string").alias("row_key"),
        F.col("o_orderkey").alias("seq"), payload.alias("after"))
    return quality.validate_with_table(events, _tenant_rules(spark, sf_dir))


@query("quality_tenant_rules", _TENANT_SQL)
def quality_tenant_rules(spark, sf_dir):
    """Rules as a table: every customer brings its own rule for its own orders."""
    return _tenant_violations(spark, sf_dir)


# The same rule set for all orders, once compiled and once as a table.
_BOTH_RULES = [
    Rule("t1", "total", "range", {"min": 20000, "max": 250000.5}, "reject"), Rule("t2", "status", "enum", {"values": ["O", "F"]}, "warn"),
    Rule("t3", "priority", "regex", {"pattern": "[1-3]-"}, "quarantine"), Rule("t4", "priority", "length", {"max": 8}, "warn"),
    Rule("t5", "note", "not_null", {}, "warn"),
    Rule("t6", "total", "custom_sql", {"expr": "seq % 3 > 0 OR after['status'] = 'P'"}, "reject"),
    Rule("t7", "customer", "custom_sql", {"expr": "after['customer'] < '5'"}, "warn")]
_BOTH_MASKS = [Transform("customer", "mask", {"mask_type": "full"}), Transform("priority", "mask", {"mask_type": "full"})]

_BOTH_SQL = """
SELECT rule_id, field_name, message, field_value, o_orderkey AS event_seq FROM (
  SELECT 't1' AS rule_id, 'total' AS field_name, CAST(o_totalprice AS VARCHAR) AS field_value, o_orderkey,
    'Field ''total'' value ' || CAST(o_totalprice AS VARCHAR) ||
    CASE WHEN o_totalprice < 20000 THEN ' below minimum 20000' ELSE ' above maximum 250000.5' END AS message
  FROM orders WHERE o_totalprice < 20000 OR o_totalprice > 250000.5::DOUBLE
  UNION ALL SELECT 't2', 'status', o_orderstatus, o_orderkey, 'Field ''status'' value ''' || o_orderstatus || ''' not in allowed set'
  FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT 't3', 'priority', '***REDACTED***', o_orderkey, 'Field ''priority'' fails regex' FROM orders
  WHERE NOT regexp_matches(o_orderpriority, '^(?:[1-3]-)')
  UNION ALL SELECT 't4', 'priority', '***REDACTED***', o_orderkey, 'Field ''priority'' fails length' FROM orders
  WHERE length(o_orderpriority) > 8
  UNION ALL SELECT 't5', 'note', NULL, o_orderkey, 'Field ''note'' is null' FROM orders
  UNION ALL SELECT 't6', 'total', CAST(o_totalprice AS VARCHAR), o_orderkey,
    'Field ''total'' fails condition seq % 3 > 0 OR after[''status''] = ''P''' FROM orders
  WHERE NOT (o_orderkey % 3 > 0 OR o_orderstatus = 'P')
  UNION ALL SELECT 't7', 'customer', '***REDACTED***', o_orderkey, 'Field ''customer'' fails custom_sql' FROM orders
  WHERE NOT (CAST(o_custkey AS VARCHAR) < '5'))
"""


@query("quality_same_rules", f"SELECT 'table' AS path, * FROM ({_BOTH_SQL}) UNION ALL SELECT 'compiled', * FROM ({_BOTH_SQL})")
def quality_same_rules(spark, sf_dir):
    """One mixed rule set, custom conditions and masks included, compiled and as a table: the same violations."""
    payload = F.create_map(
        F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"),
        F.lit("priority"), F.col("o_orderpriority"), F.lit("customer"), F.col("o_custkey").cast("string"))
    events = load(spark, sf_dir, "orders").select(
        F.lit("orders").alias("config_id"), F.col("o_orderkey").cast("string").alias("row_key"), F.col("o_orderkey").alias("seq"),
        payload.alias("after"))
    table = spark.createDataFrame(
        [(r.id, "orders", r.field_name, r.rule_type, r.severity, True, json.dumps(r.params)) for r in _BOTH_RULES],
        "id string, config_id string, field_name string, rule_type string, severity string, is_enabled boolean, rule_params string")
    by_table = quality.validate_with_table(events, table, masks=_BOTH_MASKS)
    compiled = quality.violation_rows(quality.validate(
        events, _BOTH_RULES, F.col("row_key"), F.col("seq"), "orders", field=quality.map_field, masks=_BOTH_MASKS))
    columns = ["rule_id", "field_name", "message", "field_value", "event_seq"]
    return by_table.select(F.lit("table").alias("path"), *columns).unionByName(
        compiled.select(F.lit("compiled").alias("path"), *columns))


# Metadata tables of a config for each region, made from the nations: a rule and a transform for each of them.
_METADATA_SQL = """
SELECT 'n' || n_nationkey AS rule_id, n_nationkey AS low FROM nation WHERE n_regionkey = 2 AND n_nationkey % 4 <> 1
"""


def _metadata_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation, key = load(spark, sf_dir, "nation"), F.col("n_nationkey")
    config = F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("config_id")
    rules = nation.select(
        F.concat(F.lit("n"), key.cast("string")).alias("id"), config, F.lit("k").alias("field_name"), F.lit("range").alias("rule_type"),
        F.format_string('{"min": %d}', key).alias("rule_params"), F.lit(None).cast("string").alias("severity"), (key % 4 != 1).alias("is_enabled"))
    # Of a config's transforms, in their order, only the first finds what it replaces.
    transforms = nation.select(
        config, F.lit("k").alias("source_field"), F.lit("replace").alias("transform_type"),
        F.lit('{"pattern": "1", "replacement": "one"}').alias("transform_params"), key.alias("execution_order"), F.lit(True).alias("is_enabled"))
    mapping = F.array(F.struct(F.lit("k").alias("source"), F.lit("kind").alias("target"), F.lit("uppercase").alias("transform")))
    configs = nation.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("id"), mapping.alias("field_mappings")).distinct()
    return rules, transforms, configs


@query("metadata_settings", f"""
SELECT seq, rule_id, 'warn' AS severity, replace(k, '1', 'one') AS k, upper(replace(k, '1', 'one')) AS kind
FROM ({CHANGES_SQL}) JOIN ({_METADATA_SQL}) ON CAST(k AS DOUBLE) < low WHERE op <> 'D'
""")
def metadata_settings(spark, sf_dir):
    """Rules, transforms and mappings of one config as its metadata tables hold them, applied to the log."""
    rules, transforms, configs = _metadata_tables(spark, sf_dir)
    settings = pipeline.settings_from_tables(lambda: (rules, transforms), "region2")()
    events = changes(spark, sf_dir).select(
        "op", "seq", F.create_map(F.lit("seq"), F.col("seq").cast("string")).alias("key"),
        F.when(F.col("op") != "D", F.create_map(F.lit("k"), F.col("k"))).alias("after"))
    found = pipeline.checked(events, settings).select("seq", F.explode("violations").alias("v"), F.try_element_at("after", F.lit("k")).alias("k"))
    rows = found.select("seq", "v.rule_id", "v.severity", "k")
    mapped = map_columns(rows.select("seq", "rule_id", "k"), [Mapping("seq", "seq"), Mapping("rule_id", "rule_id"),
                                                              *metadata.load_mappings(configs, "region2")])
    return rows.join(mapped, ["seq", "rule_id"])


# Versions of one rule for each order status: the limit rises every two years, and the last version is switched off for P.
_VERSIONS_SQL = """
SELECT s AS status, make_timestamp(1994 + 2 * y, 1, 1, 0, 0, 0.0) AS valid_from,
       CASE WHEN y < 3 THEN make_timestamp(1996 + 2 * y, 1, 1, 0, 0, 0.0) END AS valid_to, 20000 * (y + 1) AS low,
       NOT (s = 'P' AND y = 3) AS is_on
FROM (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT unnest(range(0, 4)) AS y)
"""


@query("rules_as_of", f"""
SELECT 'low-' || status AS rule_id, o_orderkey AS event_seq,
       'Field ''total'' value ' || CAST(o_totalprice AS VARCHAR) || ' below minimum ' || low AS message
FROM orders o JOIN ({_VERSIONS_SQL}) v ON o.o_orderstatus = v.status AND o.o_orderdate >= valid_from
  AND (valid_to IS NULL OR o.o_orderdate < valid_to) WHERE is_on AND o_totalprice < low
""")
def rules_as_of(spark, sf_dir):
    """Orders checked by the version of their status's rule that counted at the order's date."""
    orders = load(spark, sf_dir, "orders")
    events = orders.select(
        F.col("o_orderstatus").alias("config_id"), F.col("o_orderkey").cast("string").alias("row_key"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.create_map(F.lit("total"), F.col("o_totalprice").cast("string")).alias("after"))
    version = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("version")
    year, last = F.col("version") * 2 + 1994, (F.col("config_id") == "P") & (F.col("version") == 3)
    versions = orders.select(F.col("o_orderstatus").alias("config_id")).distinct().select("*", version).select(
        F.concat(F.lit("low-"), F.col("config_id")).alias("id"), "config_id", F.lit("total").alias("field_name"),
        F.lit("range").alias("rule_type"), F.lit("warn").alias("severity"), (~last).alias("is_enabled"),
        F.format_string('{"min": %d}', (F.col("version") + 1) * 20000).alias("rule_params"),
        F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("valid_from"))
    found = quality.validate_with_table(events, quality.rule_versions(versions), at="at")
    return found.select("rule_id", "event_seq", "message")


_STORED_SQL = f"SELECT *, event_seq % 4 = 0 AS resolved FROM ({_VIOLATIONS_SQL})"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.violation_rows(_validated(spark, sf_dir))
    return rows.withColumn("resolved", F.col("event_seq") % 4 == 0)


@query("violation_summary", f"""
SELECT severity, violation_type, count(*) AS count FROM ({_STORED_SQL}) WHERE NOT resolved GROUP BY ALL
""")
def violation_summary(spark, sf_dir):
    return quality.violation_summary(_stored(spark, sf_dir))


@query("violation_kpis", f"""
SELECT count(*) AS total_violations, count(*) FILTER (WHERE severity = 'reject') AS rejected,
       (SELECT count(*) FROM ({_RULES_SQL}) WHERE is_enabled) AS active_rules,
       (SELECT count(*) FROM part WHERE p_size > 10) AS active_transforms
FROM ({_STORED_SQL}) WHERE NOT resolved
""")
def violation_kpis(spark, sf_dir):
    transforms = load(spark, sf_dir, "part").select((F.col("p_size") > 10).alias("is_enabled"))
    return quality.violation_kpis(_stored(spark, sf_dir), _tenant_rules(spark, sf_dir), transforms)


@query("violation_resolve", f"""
SELECT rule_id, event_seq, event_seq % 4 = 0 OR (violation_type = 'enum' AND event_seq % 6 = 0) AS resolved
FROM ({_STORED_SQL})
""")
def violation_resolve(spark, sf_dir):
    """Resolve every sixth enum violation."""
    stored = _stored(spark, sf_dir).withColumn("violation_id", F.concat_ws("/", "rule_id", "row_key"))
    done = stored.where((F.col("violation_type") == "enum") & (F.col("event_seq") % 6 == 0))
    return status.resolve(stored, done).select("rule_id", "event_seq", "resolved")
