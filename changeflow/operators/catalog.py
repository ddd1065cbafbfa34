"""Catalog reports, schema differences, mappings, config checks and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import text


def search_tables(tables: DataFrame, term: str | None = None) -> DataFrame:
    """User tables whose name holds ``term``, by schema and name."""
    rows = tables.where(text.not_system_schema(F.col("schema_name")))
    if term:
        rows = rows.where(text.contains_ci(F.col("table_name"), term))
    return rows.orderBy("schema_name", "table_name")


def tables_per_schema(tables: DataFrame) -> DataFrame:
    return tables.groupBy("schema_name").agg(F.count("*").alias("tables"), F.sum("record_count").alias("records"))


def fields_with_keys(fields: DataFrame, keys: DataFrame, table: list[str]) -> DataFrame:
    """Fields with ``is_primary_key``: whether the column is named in the table's key."""
    named = keys.select(*table, "column_name").distinct().withColumn("_pk", F.lit(True))
    joined = fields.join(named, [*table, "column_name"], "left")
    return joined.withColumn("is_primary_key", F.col("_pk").isNotNull()).drop("_pk")


def fresh(cache: DataFrame, now: Column) -> DataFrame:
    """Cached catalog rows that have not expired."""
    return cache.where(F.col("expires_at") > now)


def schema_changes(known: DataFrame, fields: DataFrame) -> DataFrame:
    """Differences between mapped columns and the current catalog.

    ``known``: config_id, column_name, data_type, is_primary_key (the last two may be null when
    only the name was mapped). ``fields``: the same columns as now found.
    """
    side = ["data_type", "is_primary_key"]
    old = known.select("config_id", "column_name", F.struct(*side).alias("_old"))
    new = fields.select("config_id", "column_name", F.struct(*side).alias("_new"))
    both = old.join(new, ["config_id", "column_name"], "full_outer")

    def differs(name: str) -> Column:
        return F.coalesce(F.col(f"_old.{name}") != F.col(f"_new.{name}"), F.lit(False))

    kinds = F.array_compact(F.array(
        F.when(F.col("_old").isNull(), F.lit("column_added")),
        F.when(F.col("_new").isNull(), F.lit("column_removed")),
        F.when(differs("data_type"), F.lit("type_changed")),
        F.when(differs("is_primary_key"), F.lit("pk_changed")),
    ))
    return both.select(
        "config_id", "column_name", F.explode(kinds).alias("change_type"),
        F.col("_old.data_type").alias("old_type"), F.col("_new.data_type").alias("new_type"),
        F.lit("pending").alias("status"),
    )


def auto_map(changes: DataFrame) -> DataFrame:
    """New mapping rows for added columns: same name in lower case, no hint."""
    added = changes.where((F.col("change_type") == "column_added") & (F.col("status") == "pending"))
    return added.select(
        "config_id", F.col("column_name").alias("source"), F.lower("column_name").alias("target"),
        F.lit(None).cast("string").alias("transform"),
    )


def resolve_added(changes: DataFrame) -> DataFrame:
    """Changes after auto-mapping: added columns are applied, the rest stay pending."""
    added = (F.col("change_type") == "column_added") & (F.col("status") == "pending")
    return changes.withColumn("auto_resolved", added).withColumn(
        "status", F.when(added, F.lit("applied")).otherwise(F.col("status"))
    )


def extend_mappings(configs: DataFrame, new_mappings: DataFrame) -> DataFrame:
    """Configs with the new mappings appended to their list, in source order."""
    item = F.struct("source", "target", "transform")
    lists = new_mappings.groupBy("config_id").agg(F.array_sort(F.collect_list(item)).alias("_new"))
    joined = configs.join(lists, "config_id", "left")
    grown = F.when(F.col("_new").isNull(), F.col("field_mappings")).otherwise(F.concat("field_mappings", "_new"))
    return joined.withColumn("field_mappings", grown).drop("_new")


def check_configs(configs: DataFrame, connectors: DataFrame) -> DataFrame:
    """Three checks per config. ``valid`` rests on the first two; the key check only reports.

    ``configs``: config_id, connector_id, field_mappings (array of structs with ``source``),
    primary_key_fields (array of text).
    """
    known = connectors.select("connector_id").distinct().withColumn("_found", F.lit(True))
    rows = configs.join(known, "connector_id", "left")
    sources = F.coalesce(F.transform("field_mappings", lambda m: m["source"]), F.array().cast("array<string>"))
    exists = F.col("_found").isNotNull()
    mapped = F.size(sources) > 0
    keyed = F.size(F.array_except("primary_key_fields", sources)) == 0
    return rows.select(
        "config_id",
        exists.alias("connector_exists"),
        mapped.alias("field_mappings_present"),
        keyed.alias("pk_in_mappings"),
        (exists & mapped).alias("valid"),
    )


def column_lineage(mappings: DataFrame, transforms: DataFrame) -> DataFrame:
    """One row per mapped column with its transform chain and whether it is masked.

    ``mappings``: config_id, source, target, transform. ``transforms``: config_id, source_field,
    transform_type, transform_params, execution_order, is_enabled. Hashing is no masking.
    """
    step = F.struct("execution_order", "transform_type", "transform_params")
    chain = transforms.where("is_enabled").groupBy("config_id", F.col("source_field").alias("source")).agg(
        F.array_sort(F.collect_list(step)).alias("_steps"),
        F.bool_or(F.col("transform_type") == "mask").alias("_masked"),
    )
    joined = mappings.join(chain, ["config_id", "source"], "left")
    none = F.array().cast("array<struct<type:string,params:string>>")
    steps = F.transform("_steps", lambda s: F.struct(
        s["transform_type"].alias("type"), s["transform_params"].alias("params")))
    return joined.select(
        "config_id", "source", "target",
        F.coalesce(steps, none).alias("transformations"),
        F.coalesce("_masked", F.lit(False)).alias("masking_applied"),
    )


def lineage_columns_per_table(lineage: DataFrame, by: list[str]) -> DataFrame:
    return lineage.groupBy(*by).agg(F.count("*").alias("columns"))


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign key values without a parent row and how many child rows hold each."""
    found = all_orphans(child, {"": (foreign_key, parent, key)})
    return found.select(F.col("key_value").cast(child.schema[foreign_key].dataType).alias("key_value"), "child_rows")


def all_orphans(child: DataFrame, parents: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(parent, key_value, child_rows): values of all foreign keys of a child without a parent row, in one scan of it.

    ``parents`` maps a name to the foreign key column, the parent table and its key. Child rows are counted per key name
    and value on the map side, so a hot value crosses the join as one row. Values are compared as text if the types of
    the keys differ, and are of the common type of the keys otherwise; a null foreign key needs no parent.
    """
    kinds = {child.schema[fk].dataType for fk, _, _ in parents.values()}
    kind = kinds.pop() if len(kinds) == 1 else T.StringType()
    names = F.array(*[F.struct(F.lit(n).alias("parent"), F.col(fk).cast(kind).alias("key_value")) for n, (fk, _, _) in parents.items()])
    values = child.select(F.inline(names)).where(F.col("key_value").isNotNull()).groupBy("parent", "key_value").agg(
        F.count("*").alias("child_rows"))
    known = None
    for name, (_, parent, key) in parents.items():
        keys = parent.select(F.lit(name).alias("parent"), F.col(key).cast(kind).alias("key_value"))
        known = keys if known is None else known.unionByName(keys)
    return values.join(known, ["parent", "key_value"], "left_anti")
