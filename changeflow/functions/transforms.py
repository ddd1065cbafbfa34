"""Registry of column transforms: type name to a builder ``(column, params) -> column``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeflow.functions import numbers, text
from changeflow.schemas import Transform

Builder = Callable[[Column, dict[str, Any]], Column]


def _text_of(x: Column) -> Column:
    return x.cast("string")


def typed_cast(x: Column, kind: str) -> Column:
    """Cast by type name; null where the value does not convert, unchanged for an unknown name."""
    if kind in ("int", "integer"):
        return numbers.parse_int(x)
    if kind in ("float", "double", "decimal"):
        return numbers.parse_float(x)
    if kind in ("bool", "boolean"):
        return numbers.parse_bool(x)
    if kind in ("str", "string"):
        return _text_of(x)
    return x


def text_cast(x: Column, kind: str) -> Column:
    """The same cast inside a text payload: a value that does not convert stays as it is."""
    if kind in ("bool", "boolean"):
        return F.initcap(numbers.parse_bool(x).cast("string"))
    return F.coalesce(typed_cast(x, kind).cast("string"), _text_of(x))


def _hash(x: Column, params: dict[str, Any]) -> Column:
    algorithm = params.get("algorithm", "sha256")
    if algorithm == "md5":
        return F.md5(_text_of(x))
    return F.sha2(_text_of(x), 512 if algorithm == "sha512" else 256)


def _default(x: Column, params: dict[str, Any]) -> Column:
    return F.coalesce(x, F.lit(params.get("value")))


def _custom(x: Column, params: dict[str, Any]) -> Column:
    """Spark SQL text in ``expr``; without it the value passes unchanged."""
    return F.expr(params["expr"]) if params.get("expr") else x


TRANSFORMS: dict[str, Builder] = {
    "upper": lambda x, p: F.upper(_text_of(x)),
    "lower": lambda x, p: F.lower(_text_of(x)),
    "trim": lambda x, p: text.strip(_text_of(x)),
    "cast": lambda x, p: typed_cast(x, p.get("type", "str")),
    "hash": _hash,
    "mask": lambda x, p: text.mask(_text_of(x), p.get("mask_type", "full")),
    "substr": lambda x, p: text.python_slice(_text_of(x), p.get("start", 0), p.get("length")),
    "replace": lambda x, p: text.replace_literal(_text_of(x), p.get("pattern", ""), p.get("replacement", "")),
    "default": _default,
    "custom": _custom,
}


def register_transform(name: str, builder: Builder) -> None:
    """Add or replace a transform type."""
    TRANSFORMS[name] = builder


def chains(specs: Iterable[Transform]) -> dict[str, list[Transform]]:
    """Enabled specs by field, each chain in execution order; equal orders keep their place."""
    result: dict[str, list[Transform]] = {}
    for spec in sorted((s for s in specs if s.is_enabled), key=lambda s: s.execution_order):
        result.setdefault(spec.source_field, []).append(spec)
    return result


def fold_chain(x: Column, chain: list[Transform], in_text: bool = False) -> Column:
    """Apply a chain to a column. Unknown types leave the value unchanged."""
    for step in chain:
        if step.transform_type == "cast" and in_text:
            x = text_cast(x, step.params.get("type", "str"))
            continue
        builder = TRANSFORMS.get(step.transform_type)
        x = builder(x, step.params) if builder else x
    return x
