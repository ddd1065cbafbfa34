"""Row quality: violations per row, violation rows, and the routing of rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.numbers import parse_float, without_nan
from changeflow.functions.rules import RULES, rule_message
from changeflow.functions.transforms import chains, fold_chain
from changeflow.schemas import VIOLATION, Rule, Transform
from changeflow.session import SMALL_SIDE_ROWS, lookup_join

PASS, REJECT, QUARANTINE = "pass", "reject", "quarantine"


def map_field(name: str, payload: str = "after") -> Column:
    """A field of a map payload; absent and null are the same here."""
    return F.try_element_at(F.col(payload), F.lit(name))


def validate(
    rows: DataFrame,
    rules: Iterable[Rule],
    row_key: Column,
    seq: Column,
    config_id: str = "",
    field: Callable[[str], Column] = F.col,
    present: Column | None = None,
    masks: Iterable[Transform] = (),
) -> DataFrame:
    """Add ``violations``, one struct per violated rule, in rule order.

    ``field`` turns a field name into a column (``map_field`` for map payloads). ``present`` is
    false for rows without a payload, such as deletes, which pass. Rules compile to expressions,
    so a batch is checked in one scan. With ``masks`` the reported value goes through the
    field's own masking chain, and messages that quote a value do not.
    """
    masking = {name: chain for name, chain in chains(masks).items() if any(t.transform_type == "mask" for t in chain)}
    numeric = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)} if field is F.col else set()
    fields = ",".join(column.strip().replace(" ", ":") for column in VIOLATION.split(","))
    empty = F.array().cast(f"array<struct<{fields}>>")
    messages, found = {}, []
    for rule in (r for r in rules if r.is_enabled):
        value = field(rule.field_name)
        message = rule_message(rule, value, rule.field_name in numeric)
        shown = value.cast("string")
        if rule.field_name in masking:
            shown = fold_chain(shown, masking[rule.field_name], in_text=True)
            if rule.rule_type != "not_null":
                message = F.when(message.isNotNull(), F.lit(f"Field '{rule.field_name}' fails {rule.rule_type}"))
        name = f"_message_{len(messages)}"
        messages[name] = message if present is None else F.when(present, message)
        struct = F.struct(
            F.lit(rule.id).alias("rule_id"),
            F.lit(config_id).alias("config_id"),
            F.lit(rule.field_name).alias("field_name"),
            shown.alias("field_value"),
            row_key.alias("row_key"),
            F.lit(rule.rule_type).alias("violation_type"),
            F.lit(rule.severity).alias("severity"),
            F.col(name).alias("message"),
            seq.cast("bigint").alias("event_seq"),
        )
        found.append(F.when(F.col(name).isNotNull(), F.array(struct)).otherwise(empty))
    # Messages are columns of their own first, so that each rule is evaluated once per row. Lists of none or one are joined,
    # as a list with nulls could only be rid of them by a function that is interpreted for every row.
    checked = rows.withColumns(messages) if messages else rows
    violations = F.concat(*found) if found else empty
    return checked.withColumn("violations", violations).drop(*messages)


RULES_AT_ONCE = 250


def validate_many(rows: DataFrame, rules: Iterable[Rule], row_key: Column, seq: Column, *args, **options) -> DataFrame:
    """``validate`` for any number of rules: they are compiled in groups, whose violations are joined in rule order."""
    rules = list(rules)
    if len(rules) <= RULES_AT_ONCE:
        return validate(rows, rules, row_key, seq, *args, **options)
    parts = []
    for at in range(0, len(rules), RULES_AT_ONCE):
        parts.append(f"_violations_{at}")
        group = validate(rows, rules[at:at + RULES_AT_ONCE], row_key, seq, *args, **options)
        rows = group.withColumnRenamed("violations", parts[-1])
    return rows.withColumn("violations", F.concat(*parts)).drop(*parts)


def violation_rows(validated: DataFrame) -> DataFrame:
    """One row per violated rule."""
    # A plain explode would make the optimizer check all rules once more in a filter on the scan.
    exploded = validated.select(F.explode_outer("violations").alias("_v"))
    return exploded.where(F.col("_v").isNotNull()).select("_v.*")


def _with_message(paired: DataFrame, message: Column) -> DataFrame:
    """The rows that have a message, with it.

    A plain filter would be pushed into the join before it and work out every message there a second time.
    """
    told = paired.withColumn("_told", message)
    return told.withColumn("message", F.explode_outer(F.array("_told"))).drop("_told").where(F.col("message").isNotNull())


def with_route(validated: DataFrame, quarantine_blocks: bool = True) -> DataFrame:
    """Add ``route``: reject, quarantine or pass. Warnings pass.

    ``quarantine_blocks=False`` lets quarantined rows through, so only reject holds a row back.
    """
    def has(severity: str) -> Column:
        return F.exists("violations", lambda v: v["severity"] == severity)

    route = F.when(has("reject"), F.lit(REJECT))
    if quarantine_blocks:
        route = route.when(has("quarantine"), F.lit(QUARANTINE))
    return validated.withColumn("route", route.otherwise(F.lit(PASS)))


# Rule types whose conditions are expressions over columns of the rule table.
COLUMN_TYPES = ["not_null", "range", "length", "enum", "regex"]


def _limit(name: str) -> Column:
    """A limit of ``rule_params`` as it is written: a whole number keeps its digits, another is a double."""
    text = F.get_json_object("rule_params", f"$.{name}")
    return F.when(text.rlike("^-?[0-9]+$"), text).otherwise(text.cast("double").cast("string"))


def _compiled_messages(rows: DataFrame, rules: DataFrame, max_rules: int,
                       meet: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Events that violate a rule of their config that is no column expression, such as a custom condition, and its message.

    Each distinct (type, field, params) is compiled once, in groups, however many tenants have it, and a row of the rule
    table chooses its own. A condition may use any column of the event.
    """
    signs = ["rule_type", "field_name", "rule_params"]
    others = rules.where(~F.col("rule_type").isin(COLUMN_TYPES) & F.col("rule_type").isin(list(RULES)))
    distinct = others.select(*signs).distinct().orderBy(*signs).collect()
    found = None
    for at in range(0, len(distinct), RULES_AT_ONCE):
        message, chosen = F.lit(None).cast("string"), F.lit(False)
        for kind, name, params in distinct[at:at + RULES_AT_ONCE]:
            is_it = (F.col("rule_type") == kind) & (F.col("field_name") == name) & F.col("rule_params").eqNullSafe(F.lit(params))
            message = F.when(is_it, rule_message(Rule("", name, kind, json.loads(params or "{}")), map_field(name))).otherwise(message)
            chosen = chosen | is_it
        # Without a known size of the rules, a join on a single config would send the events to all tasks.
        paired = meet(lookup_join(rows, others.where(chosen), ["config_id"], max_rows=max_rules))
        part = _with_message(paired, message).withColumn("field_value", F.try_element_at("after", F.col("field_name")))
        found = part if found is None else found.unionByName(part)
    return found


def rule_versions(versions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``valid_to`` to rules with ``valid_from``: a version counts until the next one of its rule, the last for good."""
    window = Window.partitionBy(*(by or ["config_id", "id"])).orderBy("valid_from")
    return versions.withColumn("valid_to", F.lead("valid_from").over(window))


def validate_with_table(events: DataFrame, rules: DataFrame, max_rules: int = SMALL_SIDE_ROWS,
                        masks: Iterable[Transform] = (), at: str | None = None) -> DataFrame:
    """Violation rows for rule sets too large to compile, such as rules of many tenants.

    ``events``: config_id, row_key, seq, after (map) and what custom conditions use. ``rules``: id, config_id, field_name,
    rule_type, severity, is_enabled and rule_params, JSON as the metadata tables hold it (or min_value, max_value, pattern
    and allowed instead). A field meets only the rules of its own config and name. Messages, masks and what passes are those of ``validate``, for all types that are registered.
    With ``at``, a time column of the events, rules have valid_from and valid_to as of ``rule_versions``, and an event
    meets the versions of its time, so that a replay is checked by the rules of then.
    """
    spans = ["valid_from", "valid_to"] if at else []
    if "rule_params" not in rules.columns:
        limits = [F.col(c).alias(n) for c, n in (("min_value", "min"), ("max_value", "max"), ("pattern", "pattern"), ("allowed", "values"))]
        rules = rules.withColumn("rule_params", F.to_json(F.struct(*limits)))
    active = rules.where("is_enabled").select(
        "config_id", F.col("id").alias("rule_id"), "field_name", "rule_type", "severity", "rule_params", *spans)
    rows = events.where(F.col("after").isNotNull())
    timed = [at] if at else []

    def of_its_time(paired: DataFrame) -> DataFrame:
        if not at:
            return paired
        return paired.where((F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))))

    # Each field meets its own rules only. Fields that a config requires and a row lacks are added as nulls.
    required = active.where(F.col("rule_type") == "not_null").groupBy("config_id").agg(
        F.collect_set("field_name").alias("_required"))
    whole = lookup_join(rows.select("config_id", "row_key", "seq", "after", *timed), required, ["config_id"], "left", max_rules)
    lacking = F.array_except(F.coalesce("_required", F.array().cast("array<string>")), F.map_keys("after"))
    entries = F.concat(F.map_entries("after"), F.transform(
        lacking, lambda name: F.struct(name.alias("key"), F.lit(None).cast("string").alias("value"))))
    fields = whole.select("config_id", "row_key", "seq", *timed, F.inline(entries).alias("field_name", "field_value"))
    allowed = F.from_json(F.get_json_object("rule_params", "$.values"), "array<string>")
    plain = active.where(F.col("rule_type").isin(COLUMN_TYPES)).select(
        "*", _limit("min").alias("_low"), _limit("max").alias("_high"),
        F.coalesce(F.get_json_object("rule_params", "$.pattern"), F.lit("")).alias("_pattern"),
        F.coalesce(allowed, F.array().cast("array<string>")).alias("_allowed"))
    paired = of_its_time(lookup_join(fields, plain, ["config_id", "field_name"], max_rows=max_rules))
    x, kind, size = F.col("field_value"), F.col("rule_type"), F.length("field_value")
    number = without_nan(parse_float(x))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")

    def beyond(measure: str, shown: Column, side: str, limit: str) -> Column:
        return F.concat(F.lit(f"{measure} "), shown.cast("string"), F.lit(f" {side} "), F.col(limit))

    problem = (
        F.when((kind == "not_null") & x.isNull(), F.lit("is null"))
        .when((kind == "range") & (number < low), beyond("value", x, "below minimum", "_low"))
        .when((kind == "range") & (number > high), beyond("value", x, "above maximum", "_high"))
        .when((kind == "length") & (size < low), beyond("length", size, "below minimum", "_low"))
        .when((kind == "length") & (size > high), beyond("length", size, "above maximum", "_high"))
        .when((kind == "enum") & x.isNotNull() & ~F.array_contains("_allowed", x),
              F.concat(F.lit("value '"), x, F.lit("' not in allowed set")))
        .when((kind == "regex") & ~F.rlike(x, F.concat(F.lit("(?U)^(?:"), F.col("_pattern"), F.lit(")"))),
              F.concat(F.lit("doesn't match pattern '"), F.col("_pattern"), F.lit("'")))
    )
    message = F.concat(F.lit("Field '"), F.col("field_name"), F.lit("' "), problem)
    columns = ["rule_id", "config_id", "field_name", "field_value", "row_key", "rule_type", "severity", "message", "seq"]
    found = _with_message(paired, message).select(*columns)
    compiled = _compiled_messages(rows, active, max_rules, of_its_time)
    if compiled is not None:
        found = found.unionByName(compiled.select(*columns))
    shown, told = F.col("field_value"), F.col("message")
    for name, chain in chains(masks).items():
        if any(t.transform_type == "mask" for t in chain):
            here = F.col("field_name") == name
            shown = F.when(here, fold_chain(F.col("field_value"), chain, in_text=True)).otherwise(shown)
            hidden = F.concat(F.lit(f"Field '{name}' fails "), F.col("rule_type"))
            told = F.when(here & (F.col("rule_type") != "not_null"), hidden).otherwise(told)
    return found.select(
        "rule_id", "config_id", "field_name", shown.alias("field_value"), "row_key",
        F.col("rule_type").alias("violation_type"), "severity", told.alias("message"), F.col("seq").alias("event_seq"),
    )


def violation_summary(violations: DataFrame) -> DataFrame:
    """Unresolved violations by severity and type."""
    return violations.where(~F.col("resolved")).groupBy("severity", "violation_type").agg(F.count("*").alias("count"))


def violation_kpis(violations: DataFrame, rules: DataFrame, transforms: DataFrame) -> DataFrame:
    """Unresolved violations, those that held a row back, active rules and active transforms."""
    open_ones = violations.where(~F.col("resolved")).select(
        F.when(F.col("severity") == "reject", "rejected").otherwise("other").alias("kind"))
    kinds = open_ones.unionByName(rules.where("is_enabled").select(F.lit("rule").alias("kind"))).unionByName(
        transforms.where("is_enabled").select(F.lit("transform").alias("kind")))
    return kinds.agg(
        F.count_if(F.col("kind").isin("rejected", "other")).alias("total_violations"),
        F.count_if(F.col("kind") == "rejected").alias("rejected"),
        F.count_if(F.col("kind") == "rule").alias("active_rules"),
        F.count_if(F.col("kind") == "transform").alias("active_transforms"),
    )
