"""Table-wide column transforms and source-to-target mappings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.transforms import chains, fold_chain, typed_cast
from changeflow.schemas import Mapping, Transform


def transform_columns(rows: DataFrame, specs: Iterable[Transform], cast_errors: str | None = None) -> DataFrame:
    """Apply all chains in one projection; fields the table lacks are skipped.

    ``cast_errors`` names an optional array column listing the fields whose cast failed, since a
    typed column cannot keep the raw text.
    """
    by_field = chains(specs)
    columns = [
        (fold_chain(F.col(c), by_field[c]).alias(c) if c in by_field else F.col(c)) for c in rows.columns
    ]
    if cast_errors is not None:
        flags = [_cast_failed(c, by_field[c]) for c in rows.columns if c in by_field]
        columns.append(F.array_compact(F.array(*flags)).alias(cast_errors) if flags
                       else F.array().cast("array<string>").alias(cast_errors))
    return rows.select(*columns)


def _cast_failed(name: str, chain: list[Transform]) -> Column:
    failed = F.lit(False)
    value = F.col(name)
    for step in chain:
        if step.transform_type == "cast":
            result = typed_cast(value, step.params.get("type", "str"))
            failed = failed | (value.isNotNull() & result.isNull())
        value = fold_chain(value, [step])
    return F.when(failed, F.lit(name))


def transform_payload(rows: DataFrame, specs: Iterable[Transform], payload: str = "after") -> DataFrame:
    """Apply all chains to a map payload in one pass; absent fields stay absent."""
    by_field = chains(specs)
    if not by_field:
        return rows

    def rewritten(entry: Column) -> Column:
        value = entry["value"]
        result = None
        for name, chain in by_field.items():
            changed = fold_chain(value, chain, in_text=True)
            is_field = entry["key"] == name
            result = F.when(is_field, changed) if result is None else result.when(is_field, changed)
        return F.struct(entry["key"].alias("key"), result.otherwise(value).alias("value"))

    entries = F.transform(F.map_entries(payload), rewritten)
    return rows.withColumn(payload, F.when(F.col(payload).isNotNull(), F.map_from_entries(entries)))


# Mapping hints and the transforms they stand for.
_HINTS = {"uppercase": "upper", "lowercase": "lower", "trim": "trim", "upper": "upper", "lower": "lower"}


def hint_transform(mapping: Mapping) -> list[Transform]:
    hint = mapping.transform
    if not hint:
        return []
    name, _, argument = hint.partition(":")
    if name == "cast":
        return [Transform(mapping.source, "cast", {"type": argument or "str"})]
    return [Transform(mapping.source, _HINTS[name])] if name in _HINTS else []


def map_columns(rows: DataFrame, mappings: Iterable[Mapping], keep: Iterable[str] = ()) -> DataFrame:
    """Project source columns to target columns, with each mapping's hint applied."""
    columns = [fold_chain(F.col(m.source), hint_transform(m)).alias(m.target) for m in mappings]
    return rows.select(*keep, *columns)
