"""Late rows: split off by the watermark before the windows, kept and counted, so that every row is accounted for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.session import committed_folders

MARK = "newest_us long, on_time long, late long, undated long"


@dataclass
class CountedWindows:
    """Windowed sums of a stream in ``foreachBatch``, with the rows that came too late beside them.

    The watermark of a batch is the newest time of all batches before less ``late``; it is read from the mark that the
    batch before left. A window's sums are kept by batch and added up when they are read, so a repeated batch counts
    once, and nothing is held in memory between batches.
    """

    spark: SparkSession
    path: str
    ts: str
    late: str = "1 hour"

    def _mark(self, batch_id: int) -> DataFrame:
        folder = committed_folders(self.spark, f"{self.path}/mark/batch={batch_id}")
        return self.spark.read.schema(MARK).parquet(*folder) if folder else self.spark.createDataFrame([], MARK)

    def _newest_before(self, batch_id: int) -> int | None:
        """Newest time of all batches before, in microseconds."""
        return self._mark(batch_id - 1).agg(F.max("newest_us")).first()[0]

    def split(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """``batch`` with ``arrival``: on_time, late, or undated for rows without a time. In the first batch none is late."""
        newest, at = self._newest_before(batch_id), F.col(self.ts).cast("timestamp")
        mark = F.timestamp_micros(F.lit(newest).cast("bigint")) - F.expr(f"INTERVAL {self.late}")
        is_late = F.coalesce(at < mark, F.lit(False))
        return batch.withColumn("arrival", F.when(at.isNull(), "undated").when(is_late, "late").otherwise("on_time"))

    def process(self, batch: DataFrame, batch_id: int, by: list[str], sums: dict[str, Column], length: str = "1 hour") -> None:
        """Add a batch: sums per group and window of rows on time, the other rows as they are, and the mark."""
        rows = self.split(batch, batch_id).persist()
        try:
            window = F.window(F.col(self.ts).cast("timestamp"), length).alias("w")
            counted = rows.where("arrival = 'on_time'").groupBy(*by, window).agg(
                *[F.sum(c).alias(n) for n, c in sums.items()])
            out = counted.select(*by, F.col("w.start").alias("window_start"), *sums)
            out.write.mode("overwrite").parquet(f"{self.path}/windows/batch={batch_id}")
            rows.where("arrival <> 'on_time'").write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
            newest = F.greatest(F.max(F.unix_micros(F.col(self.ts).cast("timestamp"))), F.lit(self._newest_before(batch_id)).cast("bigint"))
            mark = rows.agg(newest.alias("newest_us"), *[
                F.count_if(F.col("arrival") == a).alias(a) for a in ("on_time", "late", "undated")])
            mark.write.mode("overwrite").parquet(f"{self.path}/mark/batch={batch_id}")
        finally:
            rows.unpersist()

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*")

    def windows(self, by: list[str], sums: list[str]) -> DataFrame:
        """Sums per group and window over all batches."""
        return self._all("windows").groupBy(*by, "window_start").agg(*[F.sum(c).alias(c) for c in sums])

    def late_rows(self) -> DataFrame:
        """Rows that came too late or without a time, with their batch and ``arrival``."""
        return self._all("late")

    def arrivals(self) -> DataFrame:
        """(batch, on_time, late, undated): how many rows of each batch went where."""
        return self._all("mark").select("batch", "on_time", "late", "undated")


def windowed_batches(flow: CountedWindows, by: list[str], sums: dict[str, Column], length: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds each batch."""
    return lambda batch, batch_id: flow.process(batch, batch_id, by, sums, length)
