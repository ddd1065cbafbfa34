"""Catalog rows of Spark tables, and target creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Catalog type names of Spark types.
_TYPE_NAMES = {
    "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE",
    "float": "REAL", "string": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN", "binary": "BLOB",
}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return "DECIMAL"
    return _TYPE_NAMES.get(kind.simpleString(), kind.simpleString().upper())


def field_rows(spark: SparkSession, schema_name: str, tables: dict[str, DataFrame],
               keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns of tables by position, with key flags. Reads schemas only, no data."""
    rows = [
        (schema_name, name, f.name, i, type_name(f.dataType), f.nullable, f.name in (keys or {}).get(name, []))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    ddl = ("schema_name string, table_name string, column_name string, position int, data_type string, "
           "is_nullable boolean, is_primary_key boolean")
    return spark.createDataFrame(rows, ddl)


def table_counts(tables: dict[str, DataFrame], schema_name: str) -> DataFrame:
    """One row per table with its row count."""
    counted = [
        df.agg(F.count("*").alias("record_count")).select(
            F.lit(schema_name).alias("schema_name"), F.lit(name).alias("table_name"),
            F.lit("TABLE").alias("table_type"), "record_count")
        for name, df in tables.items()
    ]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionByName(other)
    return result


def create_empty(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """Create a target with the given columns unless one is there."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
