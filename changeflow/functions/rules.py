"""Registry of quality rules: type name to a builder of the violation message.

A builder gives a text column that is null when the value passes. A value that cannot be
compared passes, and so does a missing value in every rule but ``not_null``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeflow.functions.numbers import parse_float, without_nan
from changeflow.schemas import Rule

Builder = Callable[[str, Column, dict[str, Any]], Column]

# The wording of all messages below.

def _message(field: str, *parts: str | Column) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(f"Field '{field}' "), *columns)


def _bounds(measure: Column, params: dict[str, Any], convert: Callable[[Any], Any], describe: list[str | Column],
            field: str) -> Column:
    """Below is tested before above; both ends are inside the range."""
    low, high = params.get("min"), params.get("max")
    # One flat case, in which the measure of both conditions is worked out once.
    cases = []
    if low is not None:
        cases.append((measure < F.lit(convert(low)), _message(field, *describe, f" below minimum {low}")))
    if high is not None:
        cases.append((measure > F.lit(convert(high)), _message(field, *describe, f" above maximum {high}")))
    result = F
    for condition, text in cases:
        result = result.when(condition, text)
    return result if cases else F.lit(None).cast("string")


def _not_null(field: str, value: Column, params: dict[str, Any]) -> Column:
    return F.when(value.isNull(), _message(field, "is null"))


def _range(field: str, value: Column, params: dict[str, Any]) -> Column:
    number = without_nan(value.cast("double") if params.get("_numeric") else parse_float(value))
    return _bounds(number, params, float, ["value ", value.cast("string")], field)


def _regex(field: str, value: Column, params: dict[str, Any]) -> Column:
    pattern = params.get("pattern", "")
    hit = value.cast("string").rlike(f"(?U)^(?:{pattern})")
    return F.when(~hit, _message(field, f"doesn't match pattern '{pattern}'"))


def _enum(field: str, value: Column, params: dict[str, Any]) -> Column:
    text = value.cast("string")
    allowed = [str(v) for v in params.get("values", [])]
    outside = ~text.isin(allowed) if allowed else text.isNotNull()
    return F.when(outside, _message(field, "value '", text, "' not in allowed set"))


def _length(field: str, value: Column, params: dict[str, Any]) -> Column:
    size = F.length(value.cast("string"))
    return _bounds(size, params, int, ["length ", size.cast("string")], field)


def _custom_sql(field: str, value: Column, params: dict[str, Any]) -> Column:
    """Spark SQL condition in ``expr`` over the row; unknown counts as passed."""
    if not params.get("expr"):
        return F.lit(None).cast("string")
    return F.when(~F.expr(params["expr"]), _message(field, f"fails condition {params['expr']}"))


RULES: dict[str, Builder] = {
    "not_null": _not_null,
    "range": _range,
    "regex": _regex,
    "enum": _enum,
    "length": _length,
    "custom_sql": _custom_sql,
}


def register_rule(name: str, builder: Builder) -> None:
    """Add or replace a rule type."""
    RULES[name] = builder


def rule_message(rule: Rule, value: Column, numeric: bool = False) -> Column:
    """Message column of one rule; unknown rule types always pass.

    ``numeric`` says that the field is a number already and needs no parsing.
    """
    builder = RULES.get(rule.rule_type)
    if builder is None:
        return F.lit(None).cast("string")
    return builder(rule.field_name, value, {**rule.params, "_numeric": numeric})
