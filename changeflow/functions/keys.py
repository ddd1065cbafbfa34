"""Row keys, routing names and partition keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def key_part(row_key: Column, index: int) -> Column:
    """Part ``index`` of a composite key; null when the key has fewer parts."""
    return F.get(F.split(row_key, r"\|", -1), F.lit(index))


def key_map(row_key: Column, key_fields: list[str]) -> Column:
    """Key field name to key part; surplus parts are dropped."""
    names = F.array(*[F.lit(name) for name in key_fields])
    parts = F.array(*[key_part(row_key, i) for i in range(len(key_fields))])
    return F.map_from_arrays(names, parts)


def row_key(*parts: Column) -> Column:
    """Composite key text. A null part is written ``None`` and keeps its place."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def row_key_of_map(key: Column) -> Column:
    """Composite key text from a key map, in the map's own order."""
    parts = F.transform(F.map_values(key), lambda v: F.coalesce(v, F.lit("None")))
    return F.array_join(parts, SEPARATOR)


def topic_name(prefix: str, schema: Column, table: Column) -> Column:
    """Routing name ``prefix.schema.table`` in lower case."""
    return F.lower(F.concat_ws(".", F.lit(prefix), schema, table))


def partition_key(key: Column) -> Column:
    """Sixteen-byte digest of the sorted key values; equal keys share a partition."""
    return F.unhex(F.md5(F.array_join(F.array_sort(F.map_values(key)), SEPARATOR, "None").cast("binary")))
