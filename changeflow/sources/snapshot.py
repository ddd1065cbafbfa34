"""Chunked snapshot reads, chunk ledger and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.numbers import percent
from changeflow.operators.sequence import running_totals, sequence_gaps
from changeflow.session import committed_folders


def key_bounds(table: DataFrame, key: str) -> tuple[int, int] | None:
    """Smallest and largest key, or None for an empty table."""
    low, high = table.agg(F.min(key), F.max(key)).first()
    return None if low is None else (int(low), int(high))


def chunk_plan(table: DataFrame, key: str, chunk_size: int = 10_000, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Inclusive key ranges of equal width: chunk_id, start_pk, end_pk, chunks_total.

    Only the two bounds reach the driver, unless they are given; the ranges come from a distributed ``range``.
    """
    spark = table.sparkSession
    bounds = bounds or key_bounds(table, key)
    low, high = bounds if bounds else (0, -1)
    total = (high - low) // chunk_size + 1
    start = F.col("id") * chunk_size + low
    return spark.range(total).select(
        F.col("id").alias("chunk_id"),
        start.alias("start_pk"),
        F.least(start + (chunk_size - 1), F.lit(high)).alias("end_pk"),
        F.lit(total).cast("bigint").alias("chunks_total"),
    )


def with_chunk(table: DataFrame, key: str, chunk_size: int = 10_000, low: int | None = None) -> DataFrame:
    """Add the chunk a row belongs to. Rows without a key belong to none; ``keyless`` has them."""
    if low is None:
        bounds = key_bounds(table, key)
        low = bounds[0] if bounds else 0
    chunk = F.expr(f"(CAST(`{key}` AS BIGINT) - {low}) div {chunk_size}")
    return table.where(F.col(key).isNotNull()).withColumn("chunk_id", chunk)


def keyless(table: DataFrame, key: str) -> DataFrame:
    """Rows without a key, which no chunk or range holds; a load writes them to an output of their own."""
    return table.where(F.col(key).isNull())


# Key ranges that a resumed load hands to the scan.
MAX_RANGES = 200


def open_ranges(plan: DataFrame, max_ranges: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Key ranges of the chunks in ``plan``, neighbours joined, in order.

    Of more than ``max_ranges`` the ones with the narrowest holes between them are joined too, so that the filter of a scan
    stays small; what it then reads beyond the plan has to be dropped after it.
    """
    first, last = plan.agg(F.min("start_pk"), F.max("end_pk")).first()
    if first is None:
        return []
    holes = sequence_gaps(plan, [], "chunk_id").orderBy(F.desc("missing"), "after_seq").limit(max_ranges - 1)
    edges = plan.select("chunk_id", "start_pk", "end_pk")
    ends = holes.join(edges.withColumnRenamed("chunk_id", "after_seq").drop("start_pk"), "after_seq").join(
        edges.withColumnRenamed("chunk_id", "next_seq").drop("end_pk"), "next_seq").orderBy("after_seq")
    bounds = [first, *[key for row in ends.select("end_pk", "start_pk").collect() for key in row], last]
    return list(zip(bounds[::2], bounds[1::2], strict=True))


def chunk_read(table: DataFrame, key: str, chunk_size: int = 10_000, done: DataFrame | None = None,
               bounds: tuple[int, int] | None = None) -> DataFrame:
    """Rows in chunk order, sorted by key within a task; chunks in the ledger ``done`` are skipped.

    Chunks that are left are joined into key ranges, which reach the scan as one filter, so finished ones between them are
    not read either.
    """
    bounds = bounds or key_bounds(table, key)
    low = bounds[0] if bounds else 0
    rows = table
    if done is not None and bounds:
        done = done.select("chunk_id").distinct()
        left = chunk_plan(table, key, chunk_size, bounds).join(done, "chunk_id", "left_anti")
        parts = open_ranges(left)
        wanted = F.lit(False)
        for first, last in parts:
            wanted = wanted | F.col(key).between(first, last)
        rows = table.where(F.col(key).between(parts[0][0], parts[-1][1]) & wanted if parts else wanted)
    rows = with_chunk(rows, key, chunk_size, low)
    if done is not None:
        rows = rows.join(done, "chunk_id", "left_anti")
    return rows.repartitionByRange("chunk_id", key).sortWithinPartitions("chunk_id", key)


def range_read(table: DataFrame, key: str, partitions: int) -> DataFrame:
    """Ordered read for a key that is no whole number: sampled ranges instead of fixed widths."""
    rows = table.where(F.col(key).isNotNull())
    return rows.repartitionByRange(partitions, key).sortWithinPartitions(key)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int,
              **options: str) -> DataFrame:
    """Parallel range read of a database table; rows without a key are left out."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1] + 1,
                            numPartitions=partitions)
    return reader.load().where(F.col(key).isNotNull())


def load_progress(table: DataFrame, key: str, chunk_size: int = 10_000) -> DataFrame:
    """State of the load after each chunk: rows read, running total, current key, percent."""
    bounds = key_bounds(table, key)
    plan = chunk_plan(table, key, chunk_size, bounds)
    counts = with_chunk(table, key, chunk_size, bounds[0] if bounds else 0).groupBy("chunk_id").agg(F.count("*").alias("rows_read"))
    filled = plan.join(counts, "chunk_id", "left").withColumn("rows_read", F.coalesce("rows_read", F.lit(0)))
    progress = running_totals(filled, "chunk_id", {"rows_read": "records_read"})
    done = F.col("chunk_id") + 1
    return progress.select(
        "chunk_id",
        "rows_read",
        "records_read",
        done.alias("chunks_completed"),
        "chunks_total",
        F.col("end_pk").alias("current_pk"),
        percent(done, F.col("chunks_total")).alias("percent"),
    )


def bulk_append(rows: DataFrame, path: str, load_id: int = 0, failed: Column | None = None) -> DataFrame:
    """Write rows (column ``chunk_id``) as one load, and count each chunk in the ledger.

    A load has a folder of its own, so a retry under the same id replaces it and doubles nothing. Rows for which ``failed``
    holds are kept apart and counted apart; the rest of their chunk is loaded. Counting reads the chunk numbers alone.
    """
    folder, spark = f"{path}/load={load_id}", rows.sparkSession
    marked = rows.withColumn("_failed", F.lit(False) if failed is None else F.coalesce(failed, F.lit(False)))
    marked.write.mode("overwrite").partitionBy("_failed").parquet(folder)
    counts = spark.read.schema(marked.schema).parquet(folder).groupBy("chunk_id").agg(
        F.count_if(~F.col("_failed")).alias("records_written"), F.count_if("_failed").alias("records_failed"))
    counts.write.mode("overwrite").parquet(f"{path}/_ledger/load={load_id}")
    ledger = spark.read.schema(counts.schema).parquet(f"{path}/_ledger/load={load_id}")
    return ledger if failed is not None else ledger.drop("records_failed")


def loaded_rows(spark: SparkSession, path: str, failed: bool = False) -> DataFrame:
    """Rows of all finished loads, or those that failed, with ``chunk_id``."""
    return spark.read.parquet(*committed_folders(spark, f"{path}/load=*")).where(F.col("_failed") == failed).drop("_failed")


LEDGER = "chunk_id bigint, records_written bigint, records_failed bigint"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, records_written, records_failed) of all finished loads; a chunk of several loads has several rows."""
    folders = committed_folders(spark, f"{path}/_ledger/load=*")
    return spark.read.schema(LEDGER).parquet(*folders) if folders else spark.createDataFrame([], LEDGER)


def finished_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all finished loads."""
    return ledger(spark, path).select("chunk_id").distinct()


def snapshot_as_changes(snapshot: DataFrame, ts_ms: int = 0) -> DataFrame:
    """Loaded rows as inserts with sequence 0, older than any logged change."""
    return snapshot.select(
        "*",
        F.lit("I").alias("op"),
        F.lit(ts_ms).cast("bigint").alias("ts_ms"),
        F.lit(0).cast("bigint").alias("seq"),
    )
