"""Data model: the change log, the event envelope and the metadata tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# Table layouts as DDL text, as taken by readers and ``createDataFrame``.
CHANGE_LOG = (
    "seq_id BIGINT, op_type STRING, row_key STRING, changed_at TIMESTAMP, "
    "changed_fields STRING, is_consumed BOOLEAN"
)
ENVELOPE = (
    "source STRING, schema STRING, `table` STRING, op STRING, key MAP<STRING,STRING>, "
    "before MAP<STRING,STRING>, after MAP<STRING,STRING>, ts_ms BIGINT, seq BIGINT"
)
VIOLATION = (
    "rule_id STRING, config_id STRING, field_name STRING, field_value STRING, row_key STRING, "
    "violation_type STRING, severity STRING, message STRING, event_seq BIGINT"
)
FIELD_MAPPING = "source STRING, target STRING, transform STRING"
REPLICATION_CONFIG = (
    "id STRING, source_table_schema STRING, source_table_name STRING, target_table_name STRING, "
    "replication_mode STRING, field_mappings ARRAY<STRUCT<source:STRING,target:STRING,transform:STRING>>, "
    "primary_key_fields ARRAY<STRING>, is_enabled BOOLEAN, trigger_deployed BOOLEAN, "
    "initial_load_completed BOOLEAN, kafka_topic STRING"
)
STREAM_STATE = (
    "config_id STRING, consumer_group STRING, last_offset BIGINT, last_seq BIGINT, status STRING, "
    "error_message STRING, records_processed_total BIGINT, avg_latency_ms INT, updated_at TIMESTAMP"
)

# Columns every target table carries besides its key and payload.
META_OP, META_TS, META_SEQ, META_UPDATED = "_cdc_op", "_cdc_ts", "_cdc_seq", "_cdc_updated_at"

# Source type names and the column types a target gets.
TARGET_TYPES: dict[str, T.DataType] = {
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "SMALLINT": T.ShortType(),
    "TINYINT": T.ShortType(),
    "DECIMAL": T.DecimalType(38, 10),
    "DOUBLE": T.DoubleType(),
    "REAL": T.FloatType(),
    "VARCHAR": T.StringType(),
    "NVARCHAR": T.StringType(),
    "CHAR": T.StringType(),
    "NCHAR": T.StringType(),
    "DATE": T.DateType(),
    "TIME": T.StringType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "BOOLEAN": T.BooleanType(),
    "BLOB": T.BinaryType(),
    "CLOB": T.StringType(),
    "NCLOB": T.StringType(),
}


@dataclass(frozen=True)
class Rule:
    """One quality rule on one field."""

    id: str
    field_name: str
    rule_type: str
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "warn"
    is_enabled: bool = True


@dataclass(frozen=True)
class Transform:
    """One step of a field's transform chain."""

    source_field: str
    transform_type: str
    params: dict[str, Any] = field(default_factory=dict)
    execution_order: int = 0
    is_enabled: bool = True


@dataclass(frozen=True)
class Mapping:
    """Source column, target column and an optional transform hint such as ``cast:int``."""

    source: str
    target: str
    transform: str | None = None


def target_schema(columns: list[tuple[str, str]], typed: bool = True) -> T.StructType:
    """Target columns from (name, source type) pairs plus the meta columns.

    ``typed=False`` gives the all-text layout used when the catalog is not at hand. An unknown
    source type falls back to text.
    """
    fields = [
        T.StructField(name, TARGET_TYPES.get(kind.upper(), T.StringType()) if typed else T.StringType())
        for name, kind in columns
    ]
    meta = [
        T.StructField(META_OP, T.StringType()),
        T.StructField(META_TS, T.LongType()),
        T.StructField(META_SEQ, T.LongType()),
    ]
    return T.StructType(fields + meta)
