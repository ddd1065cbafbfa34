"""Column transforms, masks, casts and mappings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions import text
from changeflow.operators.transform import map_columns, transform_columns, transform_payload
from changeflow.plans.inputs import LOG_SQL, change_log, load
from changeflow.plans.registry import query
from changeflow.plans.sha512 import sha512_sql
from changeflow.schemas import Mapping, Transform
from changeflow.sources import changelog


def _t(field: str, kind: str, order: int = 0, **params) -> Transform:
    return Transform(field, kind, params, order)


@query("transform_strings", """
SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, p_name AS trimmed, left(p_brand, 3) AS head,
       substr(p_brand, 7) AS tail, right(p_type, 3) AS last_three, replace(p_brand, '#', '-') AS replaced,
       COALESCE(CASE WHEN p_size % 2 = 0 THEN p_type END, 'UNKNOWN') AS filled,
       upper(left(p_name, 3)) AS chained, p_name AS unchanged
FROM part
""")
def transform_strings(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("up"), F.col("p_type").alias("low"),
        F.concat(F.lit("\t  "), F.col("p_name"), F.lit(" \n ")).alias("trimmed"),
        F.col("p_brand").alias("head"), F.col("p_brand").alias("tail"), F.col("p_type").alias("last_three"),
        F.col("p_brand").alias("replaced"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("filled"),
        F.col("p_name").alias("chained"), F.col("p_name").alias("unchanged"))
    return transform_columns(part, [
        _t("up", "upper"), _t("low", "lower"), _t("trimmed", "trim"), _t("head", "substr", start=0, length=3),
        _t("tail", "substr", start=6), _t("last_three", "substr", start=-3), _t("filled", "default", value="UNKNOWN"),
        _t("replaced", "replace", pattern="#", replacement="-"), _t("chained", "upper", 10),
        _t("chained", "substr", 5, start=0, length=3), _t("unchanged", "no_such_type"), _t("absent", "upper"),
    ])


@query("transform_custom", """
SELECT c_custkey, c_acctbal * 2 AS c_acctbal, upper(c_name) || '/' || c_mktsegment AS c_name, c_mktsegment
FROM customer
""")
def transform_custom(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", "c_mktsegment")
    return transform_columns(customer, [
        _t("c_acctbal", "custom", expr="c_acctbal * 2"), _t("c_mktsegment", "custom"),
        _t("c_name", "custom", expr="concat(upper(c_name), '/', c_mktsegment)"),
    ])


@query("column_mapping", """
SELECT c_custkey AS customer_id, upper(c_name) AS customer_name, CAST(trunc(c_acctbal) AS BIGINT) AS balance,
       c_mktsegment AS segment
FROM customer
""")
def column_mapping(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
    return map_columns(customer, [
        Mapping("c_custkey", "customer_id"), Mapping("c_name", "customer_name", "uppercase"),
        Mapping("c_acctbal", "balance", "cast:int"), Mapping("c_mktsegment", "segment", "trim"),
    ])


@query("transform_cast", """
WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
         CASE o_orderkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' WHEN 3 THEN 'no' END AS flag
  FROM orders)
SELECT o_orderkey, CAST(trunc(TRY_CAST(price AS DOUBLE)) AS BIGINT) AS as_int, TRY_CAST(price AS DOUBLE) AS as_float,
       lower(flag) IN ('true', '1', 'yes') AS as_bool, CAST(o_orderkey AS VARCHAR) AS as_text,
       CASE WHEN price = 'n/a' THEN 'as_int,as_float' ELSE '' END AS failed
FROM t
""")
def transform_cast(spark, sf_dir):
    key = F.col("o_orderkey")
    price = F.when(key % 9 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    flag = F.when(key % 5 == 0, "TRUE").when(key % 5 == 1, "1").when(key % 5 == 2, "Yes").when(key % 5 == 3, "no")
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", price.alias("as_int"), price.alias("as_float"), flag.alias("as_bool"), key.alias("as_text"))
    result = transform_columns(orders, [
        _t("as_int", "cast", type="int"), _t("as_float", "cast", type="float"), _t("as_bool", "cast", type="bool"),
        _t("as_text", "cast", type="str"),
    ], cast_errors="failed")
    return result.withColumn("failed", F.array_join("failed", ","))


def _hash_input(spark: SparkSession, sf_dir: str, algorithms: list[str]) -> DataFrame:
    columns = [F.col("c_name").alias(f"h_{a}") for a in algorithms]
    customer = load(spark, sf_dir, "customer").select("c_custkey", *columns)
    return transform_columns(customer, [_t(f"h_{a}", "hash", algorithm=a) for a in algorithms])


@query("transform_hash", """
SELECT c_custkey, sha256(c_name) AS h_sha256, md5(c_name) AS h_md5, sha256(c_name) AS h_other FROM customer
""")
def transform_hash(spark, sf_dir):
    return _hash_input(spark, sf_dir, ["sha256", "md5", "other"])


# SQL here has no SHA-512, so the names of all regions stand with their digests.
_SHA512 = ", ".join(f"('{n}', '{hashlib.sha512(n.encode()).hexdigest()}')" for n in (
    "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))


@query("transform_hash_sha512", f"""
SELECT r_regionkey, digest AS h_sha512 FROM region LEFT JOIN (VALUES {_SHA512}) known(name, digest) ON name = r_name
""")
def transform_hash_sha512(spark, sf_dir):
    region = load(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("h_sha512"))
    return transform_columns(region, [_t("h_sha512", "hash", algorithm="sha512")])


@query("transform_hash_sha512_customer", f"SELECT c_custkey, digest AS h_sha512 FROM ({sha512_sql('customer', 'c_custkey', 'c_name')})")
def transform_hash_sha512_customer(spark, sf_dir):
    return _hash_input(spark, sf_dir, ["sha512"])


_PII_SQL = """
SELECT c_custkey,
       CASE c_custkey % 6 WHEN 0 THEN 'no-at-sign' WHEN 1 THEN 'a@b' WHEN 2 THEN '@x.com' WHEN 3 THEN 'x@y@z.com'
            ELSE lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com' END AS email,
       CASE WHEN c_custkey % 8 = 0 THEN '12' ELSE '(555) 123-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
            END AS phone,
       '123-45-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ssn,
       '  ' || replace(c_name, '#', ' ') || '  ' || c_mktsegment AS name,
       CAST(c_custkey * 7 AS VARCHAR) AS account, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS secret
FROM customer
"""


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    last = F.lpad((key % 10000).cast("string"), 4, "0")
    plain = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@"),
                     F.lower("c_mktsegment"), F.lit(".example.com"))
    odd = key % 6
    email = F.when(odd == 0, "no-at-sign").when(odd == 1, "a@b").when(odd == 2, "@x.com").when(odd == 3, "x@y@z.com")
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        email.otherwise(plain).alias("email"),
        F.when(key % 8 == 0, "12").otherwise(F.concat(F.lit("(555) 123-"), last)).alias("phone"),
        F.concat(F.lit("123-45-"), last).alias("ssn"),
        F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")), F.lit("  "),
                 F.col("c_mktsegment")).alias("name"),
        (key * 7).cast("string").alias("account"),
        F.when(key % 3 > 0, F.col("c_name")).alias("secret"))


@query("mask_pii", f"""
WITH p AS ({_PII_SQL}), q AS (SELECT *, split_part(email, '@', 1) AS l, split_part(email, '@', 2) AS d FROM p),
r AS (SELECT *, split_part(d, '.', 1) AS f FROM q)
SELECT c_custkey,
  CASE WHEN len(string_split(email, '@')) <> 2 OR l = '' OR f = '' THEN '***@***.***'
       ELSE left(l, 1) || '***' || CASE WHEN length(l) > 1 THEN right(l, 1) ELSE '' END || '@' ||
            left(f, 1) || '***' || CASE WHEN length(f) > 1 THEN right(f, 1) ELSE '' END || '.' ||
            substr(d, length(f) + 2) END AS email,
  CASE WHEN phone = '12' THEN '***-***-****' ELSE '***-***-' || right(phone, 4) END AS phone,
  '***-**-' || right(ssn, 4) AS ssn,
  array_to_string(list_transform(list_filter(string_split(name, ' '), lambda w: w <> ''),
                                 lambda w: left(w, 1) || '***'), ' ') AS name,
  CASE WHEN length(account) <= 4 THEN '****'
       ELSE left(account, 2) || repeat('*', length(account) - 4) || right(account, 2) END AS account,
  CASE WHEN secret IS NOT NULL THEN '***REDACTED***' END AS secret
FROM r
""")
def mask_pii(spark, sf_dir):
    kinds = {"email": "email", "phone": "phone", "ssn": "ssn", "name": "name", "account": "partial", "secret": "full"}
    return transform_columns(_pii(spark, sf_dir), [_t(f, "mask", mask_type=kind) for f, kind in kinds.items()])


@query("mask_unknown", """
SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN '***MASKED***' END AS secret, '***MASKED***' AS c_name FROM customer
""")
def mask_unknown(spark, sf_dir):
    """A kind of mask that isn't known hides the value whole; null stays null."""
    key = F.col("c_custkey")
    customer = load(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 > 0, F.col("c_name")).alias("secret"), "c_name")
    return transform_columns(customer, [_t("secret", "mask", mask_type="no_such_mask"), _t("c_name", "mask", mask_type="iban")])


@query("mask_documents", """
SELECT doc_id, length(masked) AS masked_chars, md5(masked) AS masked_md5 FROM (
  SELECT doc_id, array_to_string(list_transform(
    list_filter(string_split_regex(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1680}]+'),
                lambda w: w <> ''), lambda w: left(w, 1) || '***'), ' ') AS masked
  FROM documents)
""")
def mask_documents(spark, sf_dir):
    """Every word of whole texts reduced to its first character."""
    masked = load(spark, sf_dir, "documents").select("doc_id", text.mask_name(F.col("text")).alias("masked"))
    return masked.select("doc_id", F.length("masked").alias("masked_chars"), F.md5("masked").alias("masked_md5"))


@query("transform_payload", f"""
SELECT seq_id, op_type = 'D' AS is_delete,
       CASE WHEN op_type <> 'D' THEN CASE WHEN seq_id % 4 = 0 THEN 'none' ELSE
         md5(json_extract_string(changed_fields, '$.k')) END END AS k,
       CASE WHEN op_type <> 'D' AND seq_id % 4 = 0 THEN 'present' WHEN op_type <> 'D' THEN 'absent' END AS note,
       CASE WHEN op_type <> 'D' THEN upper(event_type) END AS kind
FROM ({LOG_SQL})
""")
def transform_map_payload(spark, sf_dir):
    """Chains on a map payload: ``default`` fills a null field and does not add an absent one."""
    decoded = changelog.decode(change_log(spark, sf_dir))
    quarter = F.col("seq_id") % 4 == 0
    entries = [F.struct(F.lit("k").alias("key"), F.when(~quarter, F.col("fields")["k"]).alias("value")),
               F.struct(F.lit("kind").alias("key"), F.col("event_type").alias("value"))]
    note = F.struct(F.lit("note").alias("key"), F.lit(None).cast("string").alias("value"))
    after = F.when(F.col("op_type") != "D", F.map_from_entries(
        F.when(quarter, F.array(*entries, note)).otherwise(F.array(*entries))))
    rows = transform_payload(decoded.withColumn("after", after), [
        _t("k", "hash", 1, algorithm="md5"), _t("k", "default", 2, value="none"), _t("note", "default", value="present"),
        _t("kind", "upper")])
    has_note = F.map_contains_key("after", "note")
    return rows.select(
        "seq_id", F.col("after").isNull().alias("is_delete"), F.try_element_at("after", F.lit("k")).alias("k"),
        F.when(has_note, F.try_element_at("after", F.lit("note"))).when(~has_note, F.lit("absent")).alias("note"),
        F.try_element_at("after", F.lit("kind")).alias("kind"))
