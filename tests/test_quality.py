import json

import pytest
from pyspark.sql import functions as F

from changeflow.functions.rules import register_rule
from changeflow.operators import quality
from changeflow.schemas import Rule, Transform


def check(spark, values, rules, **kwargs):
    rows = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "seq long, x string")
    return quality.validate(rows, rules, F.col("seq").cast("string"), F.col("seq"), "cfg", **kwargs)


def kinds(df):
    return [[v.violation_type for v in r.violations] for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("rule,values,violated", [
    (Rule("r", "x", "not_null"), [None, "", "a"], [1, 0, 0]),
    (Rule("r", "x", "range", {"min": 0, "max": 10000}), ["500", "-5", "99999", "0", "10000", "abc", "NaN", None],
     [0, 1, 1, 0, 0, 0, 0, 0]),
    (Rule("r", "x", "regex", {"pattern": r"ORD-\d+"}), ["ORD-12345", "INVALID-123", "ORD-1x", "xORD-1", "ORD-٣", None],
     [0, 1, 0, 1, 0, 0]),
    (Rule("r", "x", "enum", {"values": ["SHIPPED", 5]}), ["SHIPPED", "INVALID", "5", None], [0, 1, 0, 0]),
    (Rule("r", "x", "enum", {"values": []}), ["a", None], [1, 0]),
    (Rule("r", "x", "length", {"min": 2, "max": 5}), ["ABC", "TOOLONGSTRING", "A", "😀😀", None], [0, 1, 1, 0, 0]),
    (Rule("r", "x", "custom_sql", {"expr": "x > 'b'"}), ["a", "c", None], [1, 0, 0]),
    (Rule("r", "x", "custom_sql"), ["a"], [0]),
    (Rule("r", "x", "no_such_type"), ["a", None], [0, 0]),
    (Rule("r", "x", "not_null", is_enabled=False), [None], [0]),
])
def test_rule(spark, rule, values, violated):
    assert [len(v) for v in kinds(check(spark, values, [rule]))] == violated


def test_messages_and_struct(spark):
    rules = [Rule("r1", "x", "range", {"min": 0, "max": 10}, "reject")]
    rows = [tuple(r) for r in quality.violation_rows(check(spark, ["-5", "11"], rules)).collect()]
    assert rows == [
        ("r1", "cfg", "x", "-5", "1", "range", "reject", "Field 'x' value -5 below minimum 0", 1),
        ("r1", "cfg", "x", "11", "2", "range", "reject", "Field 'x' value 11 above maximum 10", 2)]


def test_null_breaks_only_not_null(spark):
    rules = [Rule("a", "x", "not_null", severity="reject"), Rule("b", "x", "range", {"min": 0})]
    assert kinds(check(spark, [None], rules)) == [["not_null"]]


def test_routes(spark):
    rules = [Rule("w", "x", "range", {"max": 10}, "warn"), Rule("q", "x", "enum", {"values": ["1", "99"]}, "quarantine"),
             Rule("r", "x", "not_null", {}, "reject")]
    checked = check(spark, ["1", "99", "5", None], rules)
    routes = [r.route for r in quality.with_route(checked).orderBy("seq").collect()]
    assert routes == ["pass", "pass", "quarantine", "reject"]
    routes = [r.route for r in quality.with_route(checked, quarantine_blocks=False).orderBy("seq").collect()]
    assert routes == ["pass", "pass", "pass", "reject"]


MIXED = [
    Rule("1", "amount", "not_null", {}, "reject"), Rule("2", "amount", "range", {"min": 0, "max": 1000000}, "warn"),
    Rule("3", "status", "enum", {"values": ["NEW", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED"]}, "reject"),
    Rule("4", "customer_id", "regex", {"pattern": r"^C-\d+"}, "warn")]


def events(spark, payloads):
    rows = spark.createDataFrame([(i + 1, p) for i, p in enumerate(payloads)], "seq long, after map<string,string>")
    return quality.with_route(quality.validate(
        rows, MIXED, F.col("seq").cast("string"), F.col("seq"), field=quality.map_field,
        present=F.col("after").isNotNull()))


def test_mixed_rules_on_payloads(spark):
    rows = events(spark, [{"amount": "-10", "status": "INVALID", "customer_id": "BAD"}, None, {}]).orderBy("seq").collect()
    assert [[v.violation_type for v in r.violations] for r in rows] == [["range", "enum", "regex"], [], ["not_null"]]
    assert [r.route for r in rows] == ["reject", "pass", "reject"]


def test_batch_of_four(spark):
    rows = events(spark, [
        {"amount": "100", "status": "NEW"}, {"amount": None, "status": "NEW"}, {"amount": "200", "status": "SHIPPED"},
        {"amount": "50", "status": "INVALID"}])
    assert [r.seq for r in rows.where("route = 'pass'").orderBy("seq").collect()] == [1, 3]


def test_masked_values_in_violations(spark):
    rules = [Rule("r", "x", "regex", {"pattern": "z"}), Rule("e", "x", "enum", {"values": []})]
    masks = [Transform("x", "mask", {"mask_type": "ssn"})]
    rows = quality.violation_rows(check(spark, ["123-45-6789"], rules, masks=masks)).collect()
    assert {r.field_value for r in rows} == {"***-**-6789"}
    assert all("123" not in r.message for r in rows)


def test_typed_number_column(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, 50.0)], "seq long, x double")
    checked = quality.validate(rows, [Rule("r", "x", "range", {"max": 10})], F.col("seq").cast("string"), F.col("seq"))
    assert [len(r.violations) for r in checked.orderBy("seq").collect()] == [0, 0, 0, 1]


def test_rule_table_agrees_with_compiled_rules_on_both_join_paths(spark):
    payloads = [{"amount": str(a), "status": s} for a in (-1, 5, 2000000) for s in ("NEW", "BAD")] + [{}, None]
    rows = spark.createDataFrame([(i, "c", p) for i, p in enumerate(payloads)],
                                 "seq long, config_id string, after map<string,string>")
    rows = rows.withColumn("row_key", F.col("seq").cast("string"))
    table = spark.createDataFrame([
        ("1", "c", "amount", "not_null", "reject", True, None, None, None, None),
        ("2", "c", "amount", "range", "warn", True, 0.0, 1000000.0, None, None),
        ("3", "c", "status", "enum", "reject", True, None, None, None, ["NEW"]),
        ("4", "c", "status", "regex", "warn", True, None, None, "N", None),
        ("5", "c", "status", "length", "warn", True, 3.0, 3.0, None, None),
        ("6", "d", "status", "length", "warn", True, 9.0, 9.0, None, None),
        ("7", "c", "status", "length", "warn", False, 9.0, 9.0, None, None)],
        "id string, config_id string, field_name string, rule_type string, severity string, is_enabled boolean, "
        "min_value double, max_value double, pattern string, allowed array<string>")
    rules = [Rule("1", "amount", "not_null"), Rule("2", "amount", "range", {"min": 0, "max": 1000000}),
             Rule("3", "status", "enum", {"values": ["NEW"]}), Rule("4", "status", "regex", {"pattern": "N"}),
             Rule("5", "status", "length", {"min": 3, "max": 3})]
    compiled = quality.violation_rows(quality.validate(
        rows, rules, F.col("row_key"), F.col("seq"), field=quality.map_field, present=F.col("after").isNotNull()))
    expected = sorted((r.rule_id, r.event_seq) for r in compiled.collect())
    for bound in (100, 2):
        found = quality.validate_with_table(rows, table, max_rules=bound)
        assert sorted((r.rule_id, r.event_seq) for r in found.collect()) == expected


def test_registered_rule(spark):
    register_rule("even", lambda f, v, p: F.when(v.cast("int") % 2 == 1, F.lit("odd")))
    assert kinds(check(spark, ["1", "2"], [Rule("r", "x", "even")])) == [["even"], []]


def test_summaries(spark):
    rows = spark.createDataFrame(
        [("reject", "range", False), ("reject", "range", False), ("warn", "enum", False), ("warn", "enum", True)],
        "severity string, violation_type string, resolved boolean")
    assert {tuple(r) for r in quality.violation_summary(rows).collect()} == {("reject", "range", 2), ("warn", "enum", 1)}
    flags = spark.createDataFrame([(True,), (False,), (True,)], "is_enabled boolean")
    assert tuple(quality.violation_kpis(rows, flags, flags.limit(1)).first()) == (3, 2, 2, 1)


def test_any_number_of_rules(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    rules = [Rule(f"r{i:04}", "v", "not_null" if i % 2 else "length", {"min": 2}, "warn") for i in range(23)]
    key, seq = F.col("id").cast("string"), F.col("id")
    whole = quality.validate(rows, rules, key, seq).collect()
    monkeypatch.setattr(quality, "RULES_AT_ONCE", 4)
    assert quality.validate_many(rows, rules, key, seq).collect() == whole
    assert [len(r.violations) for r in whole] == [12, 11]


def mixed_rules():
    return [Rule("1", "amount", "not_null", {}, "reject"), Rule("2", "amount", "range", {"min": 0, "max": 1000.5}),
            Rule("3", "status", "enum", {"values": ["NEW"]}, "reject"), Rule("4", "status", "regex", {"pattern": "N"}, "quarantine"),
            Rule("5", "status", "length", {"min": 4, "max": 5}), Rule("6", "amount", "custom_sql", {"expr": "seq % 2 = 0 AND after['status'] = 'NEW'"}),
            Rule("7", "code", "custom_sql", {"expr": "length(after['code']) < 3"}), Rule("8", "code", "no_such_type"),
            Rule("9", "code", "all_upper", {"than": 1}), Rule("10", "code", "custom_sql", {}), Rule("11", "status", "regex", {}),
            Rule("12", "amount", "enum", {})]


@pytest.mark.parametrize("at_once", [1, 250])
def test_one_rule_set_by_both_paths(spark, monkeypatch, at_once):
    """Custom conditions, registered types, masks and messages are the same compiled and as a table."""
    register_rule("all_upper", lambda f, v, p: F.when(v != F.upper(v), F.concat(F.lit(f"{f} isn't upper: "), v)))
    monkeypatch.setattr(quality, "RULES_AT_ONCE", at_once)
    payloads = [{"amount": str(a), "status": s, "code": c} for a in (-1, 5, "x", 2000000) for s in ("NEW", "BAD") for c in ("abc", "AB")]
    payloads += [{}, None, {"status": None, "amount": "7"}, {"code": "abcd"}]
    rows = spark.createDataFrame([(i, "c", p) for i, p in enumerate(payloads)] + [(99, "other", payloads[0])],
                                 "seq long, config_id string, after map<string,string>").withColumn("row_key", F.col("seq").cast("string"))
    masks = [Transform("code", "mask", {"mask_type": "full"}), Transform("status", "upper", {})]
    table = spark.createDataFrame(
        [(r.id, "c", r.field_name, r.rule_type, r.severity, True, json.dumps(r.params)) for r in mixed_rules()],
        "id string, config_id string, field_name string, rule_type string, severity string, is_enabled boolean, rule_params string")
    compiled = quality.violation_rows(quality.validate(
        rows.where("config_id = 'c'"), mixed_rules(), F.col("row_key"), F.col("seq"), "c", field=quality.map_field,
        present=F.col("after").isNotNull(), masks=masks))
    found = quality.validate_with_table(rows, table, masks=masks)
    assert found.columns == compiled.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, compiled.collect()), key=repr)
    assert {r.rule_id for r in found.collect()} >= {"1", "2", "3", "4", "5", "6", "7", "9"}


def test_rules_of_their_time(spark):
    versions = spark.createDataFrame([
        ("r", "c", "n", "range", "warn", True, '{"min": 10}', 0), ("r", "c", "n", "range", "warn", True, '{"min": 20}', 100),
        ("r", "c", "n", "range", "warn", False, '{"min": 30}', 200), ("s", "c", "n", "custom_sql", "warn", True, '{"expr": "after[\'n\'] <> \'15\'"}', 150)],
        "id string, config_id string, field_name string, rule_type string, severity string, is_enabled boolean, rule_params string, valid_from long")
    rows = spark.createDataFrame([(i, "c", str(i), {"n": "15"}, t) for i, t in enumerate((-5, 0, 99, 100, 160, 200, 500))],
                                 "seq long, config_id string, row_key string, after map<string,string>, t long")
    found = quality.validate_with_table(rows, quality.rule_versions(versions), at="t")
    assert sorted((r.event_seq, r.rule_id) for r in found.collect()) == [(3, "r"), (4, "r"), (4, "s"), (5, "s"), (6, "s")]


def test_rules_are_checked_once_and_events_stay_where_they_are(spark):
    """No join on a single config sends the events to all tasks, no filter repeats a message in the join, and no list is interpreted."""
    events = spark.range(50).select(
        F.lit("c").alias("config_id"), F.col("id").cast("string").alias("row_key"), F.col("id").alias("seq"),
        F.create_map(F.lit("x"), F.col("id").cast("string")).alias("after"))
    rules = [Rule("low", "x", "range", {"min": 10, "max": 40}, "warn"), Rule("own", "x", "custom_sql", {"expr": "seq % 5 > 0"}, "warn")]
    table = spark.createDataFrame([(r.id, "c", r.field_name, r.rule_type, r.severity, True, json.dumps(r.params)) for r in rules],
                                  "id string, config_id string, field_name string, rule_type string, severity string, is_enabled boolean, rule_params string")
    by_table = quality.validate_with_table(events, table)
    compiled = quality.violation_rows(quality.validate(events, rules, F.col("row_key"), F.col("seq"), "c", field=quality.map_field))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (by_table, compiled)]
    assert "BuildLeft" not in plans[0]
    assert not [line for line in plans[0].splitlines() if "Join" in line and "CASE WHEN" in line]
    assert "lambda" not in plans[1]
    found = [sorted((r.rule_id, r.event_seq, r.message) for r in df.collect()) for df in (by_table, compiled)]
    assert found[0] == found[1] and len(found[0]) == 10 + 9 + 10


@pytest.mark.parametrize("params,expected", [
    ({"min": 0, "max": 10}, [None, "below minimum 0", "above maximum 10", None, None]),
    ({"min": 20, "max": 10}, ["below minimum 20", "below minimum 20", "above maximum 10", None, None]),
    ({"max": 10}, [None, None, "above maximum 10", None, None]), ({}, [None] * 5)])
def test_bounds_with_and_without_ends(spark, params, expected):
    rows = check(spark, ["5", "-1", "30", "NaN", None], [Rule("r", "x", "range", params)]).orderBy("seq").collect()
    assert [r.violations[0].message.split(" ", 4)[-1] if r.violations else None for r in rows] == expected
