"""The change log: poll, decode, envelope, acknowledge, purge and capture from snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions import keys, text, times
from changeflow.operators.ranges import ROWS_PER_RANGE, ranked


def poll(log: DataFrame, last_seq: int = 0, limit: int | None = 1000) -> DataFrame:
    """Unconsumed rows after ``last_seq``, oldest first; ``limit`` is the batch size."""
    rows = log.where(~F.col("is_consumed") & (F.col("seq_id") > last_seq)).orderBy("seq_id")
    return rows if limit is None else rows.limit(limit)


def decode(log: DataFrame, now: Column | None = None) -> DataFrame:
    """Add ``fields`` (map of the changed columns) and ``ts_ms``.

    Text that is no JSON object gives null fields and keeps the row. Numbers keep their written
    digits instead of passing through a double. A missing change time becomes ``now``.
    """
    fields = F.expr("try_variant_get(try_parse_json(changed_fields), '$', 'map<string,string>')")
    changed_at = F.coalesce(F.col("changed_at").cast("timestamp"), now if now is not None else F.current_timestamp())
    return log.withColumn("fields", fields).withColumn("ts_ms", times.epoch_ms(changed_at))


def envelope(decoded: DataFrame, source: str, schema: str, table: str | Column, key_fields: list[str]) -> DataFrame:
    """Decoded rows as change events, of one table or of the one that a column names. Row order is carried by ``seq``."""
    no_fields = F.lit(None).cast("map<string,string>")
    return decoded.select(
        F.lit(source).alias("source"),
        F.lit(schema).alias("schema"),
        F.lit(table).alias("table"),
        F.col("op_type").alias("op"),
        keys.key_map(F.col("row_key"), key_fields).alias("key"),
        no_fields.alias("before"),
        F.when(F.col("op_type") != "D", F.col("fields")).alias("after"),
        F.col("ts_ms"),
        F.col("seq_id").alias("seq"),
    )


def mark_consumed(log: DataFrame, delivered: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Set ``is_consumed`` on the rows named in ``delivered``.

    A sequence is unique within its table only, so the table counts too where both sides have it.
    """
    on = on or [c for c in ("table_name", "seq_id") if c in log.columns and c in delivered.columns]
    acked = delivered.select(*on).distinct().withColumn("_acked", F.lit(True))
    marked = log.join(acked, on, "left").withColumn("is_consumed", F.col("is_consumed") | F.col("_acked").isNotNull())
    return marked.select(*log.columns)


def _expired(now: Column, retention: str) -> Column:
    return F.coalesce(F.col("is_consumed") & times.older_than(F.col("changed_at"), now, retention), F.lit(False))


def purge(log: DataFrame, now: Column, retention: str = "1 HOUR") -> DataFrame:
    """Rows that stay: everything but consumed rows whose change is older than ``retention``."""
    return log.where(~_expired(now, retention))


def purge_counts(log: DataFrame, now: Column, by: list[str], retention: str = "1 HOUR") -> DataFrame:
    """Per table, how many rows a purge removes and keeps."""
    gone = _expired(now, retention)
    return log.groupBy(*by).agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))


def capture(old: DataFrame, new: DataFrame, key_columns: list[str], monitored: list[str]) -> DataFrame:
    """Change rows between two snapshots: op_type, row_key, changed_fields.

    An update that changes nothing leaves no trace in snapshots and gives no row. Keys are
    unique per snapshot, so the join sees one row per side.
    """
    before = old.select(*key_columns, F.struct(*monitored).alias("_old"))
    after = new.select(*key_columns, F.struct(*monitored).alias("_new"))
    both = before.join(after, key_columns, "full_outer")
    op = (
        F.when(F.col("_old").isNull(), "I")
        .when(F.col("_new").isNull(), "D")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "U")
    )
    fields = F.when(
        F.col("_new").isNotNull(), text.row_json(*[F.col(f"_new.{name}").alias(name) for name in monitored])
    )
    return both.select(
        *key_columns,
        op.alias("op_type"),
        keys.row_key(*[F.col(k) for k in key_columns]).alias("row_key"),
        fields.alias("changed_fields"),
    ).where(F.col("op_type").isNotNull())


def number_changes(changes: DataFrame, order: list[str], start: int = 1,
                   rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Give captured changes a ``seq_id`` in the true order of ``order``: unique, gap-free, the same on every run.

    ``order`` has to tell rows apart. Rows are numbered inside sampled ranges and shifted by the sizes of those before,
    and there are as many ranges as the table needs, so no task sorts more than ``rows_per_range`` rows or so.
    """
    return ranked(changes, order, "seq_id", start, rows_per_range)
