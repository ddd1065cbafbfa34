"""Alert rules by org, the clock after firing, tenant rules by field, and open windows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changeflow.functions.numbers import in_dollars
from changeflow.operators import alerts, quality

RULE = ("rule_id string, condition_type string, severity_filter string, channel_id int, cooldown_minutes int, "
        "last_fired_at timestamp, is_enabled boolean, org_id string")
EVENT = "event_id int, at timestamp, alert_type string, severity string, org_id string, message string"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_rules_meet_events_of_their_org_and_events_without_one(spark):
    rules = spark.createDataFrame([
        ("own", "custom", None, 1, 5, None, True, "a"), ("other", "custom", None, 1, 5, None, True, "b"),
        ("empty", "custom", None, 1, 5, None, True, ""), ("none", "custom", None, 1, 5, None, True, None)], RULE)
    events = spark.createDataFrame([
        (1, T0, "custom", "info", "a", ""), (2, T0, "custom", "info", None, ""), (3, T0, "custom", "info", "", ""),
        (4, T0, "custom", "info", "c", "")], EVENT)
    channels = spark.createDataFrame([(1, True)], "channel_id int, is_active boolean")
    pairs = alerts.matching_rules(events, rules, channels).select("event_id", "rule_id").collect()
    assert sorted(map(tuple, pairs)) == [
        (1, "own"), (2, "empty"), (2, "none"), (2, "other"), (2, "own"), (3, "empty")]


def test_clock_is_the_newest_firing_and_never_goes_back(spark):
    rules = spark.createDataFrame([
        ("a", "custom", None, 1, 5, None, True, None), ("b", "custom", None, 1, 5, T1, True, None),
        ("c", "custom", None, 1, 5, T0, True, None), ("d", "custom", None, 1, 5, None, True, None)], RULE)
    history = spark.createDataFrame([("a", T0), ("a", T1), ("b", T0)], "rule_id string, fired_at timestamp")
    after = alerts.rules_after(rules, history)
    assert after.columns == rules.columns
    assert {r.rule_id: r.last_fired_at for r in after.collect()} == {"a": T1, "b": T1, "c": T0, "d": None}
    assert alerts.rules_after(rules, history.limit(0)).count() == 4


@pytest.mark.parametrize("max_rules", [0, 1000])
def test_required_fields_may_be_absent_null_or_without_rules(spark, max_rules):
    events = spark.createDataFrame([
        ("x", "absent", 1, {"n": "5"}), ("x", "null", 2, {"f": None, "n": "50"}), ("x", "there", 3, {"f": "v"}),
        ("x", "bare", 4, {}), ("x", "deleted", 5, None), ("y", "other config", 6, {"n": "50"})],
        "config_id string, row_key string, seq long, after map<string,string>")
    rules = spark.createDataFrame([
        ("need", "x", "f", "not_null", "warn", True, None, None, None, None),
        ("again", "x", "f", "not_null", "warn", True, None, None, None, None),
        ("range", "x", "n", "range", "reject", True, 1.0, 9.0, None, None),
        ("off", "x", "z", "not_null", "warn", False, None, None, None, None)],
        "id string, config_id string, field_name string, rule_type string, severity string, is_enabled boolean, "
        "min_value double, max_value double, pattern string, allowed array<string>")
    found = quality.validate_with_table(events, rules, max_rules).select("row_key", "rule_id").collect()
    assert sorted(map(tuple, found)) == [
        ("absent", "again"), ("absent", "need"), ("bare", "again"), ("bare", "need"), ("null", "again"),
        ("null", "need"), ("null", "range")]


def test_dollars_have_four_places(spark):
    rows = spark.createDataFrame([(0.00005,), (0.00004,), (1.23455,), (None,), (0.0,)], "x double")
    assert [r.y for r in rows.select(in_dollars(F.col("x")).alias("y")).collect()] == [0.0001, 0.0, 1.2346, None, 0.0]
