"""Event messages: JSON records with a partition key, and their parsing with dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from changeflow.functions import keys

REQUIRED = ["source", "schema", "table", "op", "key", "ts_ms", "seq"]
# ``before`` and ``after`` are read as variants, which keep the written digits of numbers.
_BODY = (
    "source string, schema string, `table` string, op string, key map<string,string>, before variant, after variant, "
    "ts_ms bigint, seq bigint, _broken string"
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def to_records(events: DataFrame, prefix: str = "cdc") -> DataFrame:
    """Events as topic, key and JSON value, ready for a keyed sink."""
    value = F.to_json(F.struct(*[F.col(c) for c in events.columns]), {"ignoreNullFields": "false"})
    return events.select(
        keys.topic_name(prefix, F.col("schema"), F.col("table")).alias("topic"),
        keys.partition_key(F.col("key")).alias("key"),
        value.alias("value"),
    )


def parse(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON text into event columns plus ``parse_error`` (null for a good event).

    The text is kept, so a message goes on as an event or as a dead letter and none is lost.
    """
    body = messages.withColumn("_body", F.from_json(F.col(value).cast("string"), _BODY, _OPTIONS))
    fields = body.select(*[F.col(c) for c in messages.columns], "_body.*")
    as_map = "map<string,string>"
    parsed = fields.withColumns({c: F.try_variant_get(c, "$", as_map) for c in ("before", "after")})
    absent = [F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in REQUIRED]
    broken = F.col("_broken").isNotNull() | F.col(value).isNull()
    missing = F.concat_ws(",", *absent)
    error: Column = F.when(broken, F.lit("malformed")).when(missing != "", F.concat(F.lit("missing "), missing))
    return parsed.withColumn("parse_error", error).drop("_broken")


# Columns of a message source that say where a message stood.
POSITION = ["partition", "offset"]


def positions(columns: list[str]) -> list[str]:
    """Those of the position columns that a source has."""
    return [c for c in POSITION if c in columns]


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parse_error").isNull()).drop("parse_error")


def dead_letters(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.where(F.col("parse_error").isNotNull()).select(*keep, "parse_error")


def kafka_reader(spark: SparkSession, servers: str, topics: str, per_trigger: int) -> DataStreamReader:
    """Options of a Kafka source that starts at the earliest offset; needs the connector jar."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
    )


def kafka_writer(records: DataFrame, servers: str) -> DataFrameWriter:
    """Options of a Kafka sink for ``to_records``; needs the connector jar."""
    return records.write.format("kafka").option("kafka.bootstrap.servers", servers)


def write_records(records: DataFrame, path: str, partitions: int = 6) -> None:
    """Keyed records as Parquet, one folder per key-hash partition."""
    slot = F.pmod(F.xxhash64("key"), F.lit(partitions))
    records.withColumn("partition", slot).write.mode("append").partitionBy("partition").parquet(path)
