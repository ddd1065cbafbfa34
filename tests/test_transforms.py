import hashlib

import pytest
from pyspark.sql import functions as F

from changeflow.functions import numbers
from changeflow.functions.transforms import fold_chain, register_transform
from changeflow.operators.transform import map_columns, transform_columns, transform_payload
from changeflow.schemas import Mapping, Transform


def t(kind, order=0, **params):
    return Transform("x", kind, params, order)


CASES = [
    ("john doe", [t("upper")], "JOHN DOE"),
    ("straße", [t("upper")], "STRASSE"),
    ("User@Example.COM", [t("lower")], "user@example.com"),
    ("  ABC-123  ", [t("trim")], "ABC-123"),
    (" \t x\x1c\n", [t("trim")], "x"),
    ("42.7", [t("cast", type="int")], "42"),
    ("-42.7", [t("cast", type="int")], "-42"),
    ("abc", [t("cast", type="int")], "abc"),
    ("nan", [t("cast", type="int")], "nan"),
    ("19.99", [t("cast", type="float")], "19.99"),
    ("1.0d", [t("cast", type="float")], "1.0d"),
    ("1_000", [t("cast", type="float")], "1000.0"),
    ("true", [t("cast", type="bool")], "True"),
    ("0", [t("cast", type="bool")], "False"),
    ("yes", [t("cast", type="bool")], "True"),
    ("123-45-6789", [t("hash")], "01a54629efb952287e554eb23ef69c52097a75aecc0e3a93ca0855ab6d7a31a0"),
    ("test", [t("hash", algorithm="md5")], hashlib.md5(b"test").hexdigest()),
    ("test", [t("hash", algorithm="sha512")], hashlib.sha512(b"test").hexdigest()),
    ("test", [t("hash", algorithm="unknown")], hashlib.sha256(b"test").hexdigest()),
    ("ABCDEF", [t("substr", start=0, length=3)], "ABC"),
    ("ABCDEF", [t("substr", start=2)], "CDEF"),
    ("ABCDEF", [t("substr", start=2, length=0)], "CDEF"),
    ("ABCDEF", [t("substr", start=-3)], "DEF"),
    ("ABCDEF", [t("substr", start=-3, length=3)], ""),
    ("ABCDEF", [t("substr", start=-3, length=2)], "DE"),
    ("ABCDEF", [t("substr", start=4, length=9)], "EF"),
    ("AB", [t("substr", start=-9, length=8)], "A"),
    ("555-123-4567", [t("replace", pattern="-", replacement="")], "5551234567"),
    ("a.b", [t("replace", pattern=".", replacement="$1")], "a$1b"),
    ("ab", [t("replace", pattern="", replacement="-")], "-a-b-"),
    (None, [t("default", value="UNKNOWN")], "UNKNOWN"),
    ("ACTIVE", [t("default", value="UNKNOWN")], "ACTIVE"),
    (None, [t("upper")], None),
    ("hello world", [t("upper", 10), t("substr", 5, start=0, length=3)], "HEL"),
    (None, [t("default", 1, value="pending"), t("upper", 2)], "PENDING"),
    ("123-45-6789", [t("replace", 1, pattern="-", replacement=""), t("hash", 2)],
     hashlib.sha256(b"123456789").hexdigest()),
    ("x", [t("no_such_type")], "x"),
    ("x", [t("custom")], "x"),
    ("john.doe@example.com", [t("mask", mask_type="email")], "j***e@e***e.com"),
    ("x@y.co.uk", [t("mask", mask_type="email")], "x***@y***.co.uk"),
    ("a@b", [t("mask", mask_type="email")], "a***@b***."),
    ("no-at-sign", [t("mask", mask_type="email")], "***@***.***"),
    ("@x.com", [t("mask", mask_type="email")], "***@***.***"),
    ("a@", [t("mask", mask_type="email")], "***@***.***"),
    ("a@b@c", [t("mask", mask_type="email")], "***@***.***"),
    ("(555) 123-4567", [t("mask", mask_type="phone")], "***-***-4567"),
    ("12", [t("mask", mask_type="phone")], "***-***-****"),
    ("123-45-6789", [t("mask", mask_type="ssn")], "***-**-6789"),
    ("1", [t("mask", mask_type="ssn")], "***-**-****"),
    ("John Doe", [t("mask", mask_type="name")], "J*** D***"),
    ("  Alice\tBob  Charlie ", [t("mask", mask_type="name")], "A*** B*** C***"),
    ("", [t("mask", mask_type="name")], ""),
    ("any", [t("mask", mask_type="full")], "***REDACTED***"),
    ("any", [t("mask")], "***REDACTED***"),
    ("any", [t("mask", mask_type="other")], "***MASKED***"),
    ("4111111111111111", [t("mask", mask_type="partial")], "41************11"),
    ("abcd", [t("mask", mask_type="partial")], "****"),
    (None, [t("mask", mask_type="partial")], None),
    (None, [t("mask", mask_type="email")], None),
    (None, [t("mask", mask_type="name")], None),
]


def test_values_in_payloads(spark):
    """Each case through the map payload, in one frame."""
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, x string")
    columns = []
    for i, (_, chain, _) in enumerate(CASES):
        specs = sorted(chain, key=lambda s: s.execution_order)
        columns.append(F.when(F.col("i") == i, fold_chain(F.col("x"), specs, in_text=True)))
    got = {r.i: r.y for r in rows.select("i", F.coalesce(*columns).alias("y")).collect()}
    for i, (value, chain, expected) in enumerate(CASES):
        assert got[i] == expected, (value, chain)


def test_typed_columns_and_cast_errors(spark):
    rows = spark.createDataFrame([("42.7", "yes", "a"), ("abc", None, None)], "x string, b string, s string")
    result = transform_columns(rows, [
        Transform("x", "cast", {"type": "int"}), Transform("b", "cast", {"type": "bool"}),
        Transform("absent", "upper")], cast_errors="bad")
    assert result.dtypes[:2] == [("x", "bigint"), ("b", "boolean")]
    assert [tuple(r) for r in result.collect()] == [(42, True, "a", []), (None, None, None, ["x"])]


def test_payload_keeps_absent_fields_absent(spark):
    rows = spark.createDataFrame([({"a": None, "b": "x"},), (None,), ({},)], "after map<string,string>")
    specs = [Transform("a", "default", {"value": "d"}), Transform("c", "default", {"value": "d"}),
             Transform("b", "upper"), Transform("b", "lower", is_enabled=False)]
    got = [r.after for r in transform_payload(rows, specs).collect()]
    assert got == [{"a": "d", "b": "X"}, None, {}]


def test_no_personal_value_survives(spark):
    record = {"order_id": "1", "customer_email": "john.doe@example.com", "customer_phone": "(555) 123-4567",
              "customer_ssn": "123-45-6789", "customer_name": "John Doe", "api_key": "sk_live_abc"}
    rows = spark.createDataFrame([(record,)], "after map<string,string>")
    kinds = {"customer_email": "email", "customer_phone": "phone", "customer_ssn": "ssn", "customer_name": "name",
             "api_key": "full"}
    masked = transform_payload(rows, [Transform(f, "mask", {"mask_type": k}) for f, k in kinds.items()])
    text = masked.select(F.to_json("after")).first()[0]
    for secret in ("john.doe", "555", "123-45", "John", "sk_live"):
        assert secret not in text
    assert '"order_id":"1"' in text


def test_mapping_hints(spark):
    rows = spark.createDataFrame([(" a ", "7.9")], "A string, B string")
    got = map_columns(rows, [Mapping("A", "a", "trim"), Mapping("B", "b", "cast:int"), Mapping("A", "up", "uppercase")])
    assert tuple(got.first()) == ("a", 7, " A ")


def test_registered_transform(spark):
    register_transform("twice", lambda x, p: F.concat(x, x))
    rows = spark.createDataFrame([("ab",)], "x string")
    assert transform_columns(rows, [t("twice")]).first().x == "abab"


@pytest.mark.parametrize("text,value", [
    ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), (" 7 ", 7.0), ("inf", float("inf")), ("0x10", None), ("1f", None),
    ("1__0", None), ("_1", None), ("", None), ("1_0.5", 10.5), (" 5", 5.0), ("+3", 3.0)])
def test_parse_float(spark, text, value):
    row = spark.createDataFrame([(text,)], "x string").select(numbers.parse_float(F.col("x")).alias("y")).first()
    assert row.y == value


def test_percent_rounds_ties_to_even(spark):
    rows = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (1, 16), (3, 16)], "d long, n long")
    got = [r.p for r in rows.select(numbers.percent(F.col("d"), F.col("n")).alias("p")).collect()]
    assert got == [round(d / n * 100, 1) for d, n in ((1, 3), (2, 3), (3, 3), (1, 16), (3, 16))]


def test_sha512_of_all_customers(spark):
    import hashlib

    from changeflow.plans import QUERIES, transform_queries  # noqa: F401

    folder = "/root/testdata/sf0.001"
    names = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{folder}/customer.parquet").collect()}
    got = {r["c_custkey"]: r["h_sha512"] for r in QUERIES["transform_hash_sha512_customer"](spark, folder).collect()}
    assert got == {k: hashlib.sha512(n.encode()).hexdigest() for k, n in names.items()} and len(got) > 100
