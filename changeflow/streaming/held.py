"""Paused configs: their events are held by batch and join the first batch after the pause, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import status
from changeflow.session import committed_folders

PAUSED = "config_id string, since long"


@dataclass
class Held:
    """Events of paused configs below ``path``, one folder a batch.

    A batch reads only what the batch before it left, so a repeated batch gives the same and replaces its own folders.
    """

    spark: SparkSession
    path: str

    def _paused_before(self, batch_id: int) -> DataFrame:
        """(config_id, since): who was paused after the batch before, and since which batch."""
        folder = committed_folders(self.spark, f"{self.path}/paused/batch={batch_id - 1}")
        reader = self.spark.read.schema(PAUSED)
        return reader.parquet(*folder) if folder else self.spark.createDataFrame([], PAUSED)

    def split(self, events: DataFrame, commands: DataFrame, batch_id: int) -> DataFrame:
        """What is applied now: events of running configs, and those held of configs whose pause has ended.

        ``events`` has config_id, ``commands`` all switches known at this batch. Events without a config can't be paused.
        """
        before = self._paused_before(batch_id)
        now = status.paused_configs(commands).join(before, "config_id", "left").select(
            "config_id", F.coalesce("since", F.lit(batch_id)).cast("bigint").alias("since"))
        now.write.mode("overwrite").parquet(f"{self.path}/paused/batch={batch_id}")
        now = self._paused_before(batch_id + 1).select("config_id")
        events.join(now, "config_id", "left_semi").select(*events.columns).write.mode("overwrite").parquet(
            f"{self.path}/held/batch={batch_id}")
        running = events.join(now, "config_id", "left_anti").select(*events.columns)
        ended = before.join(now, "config_id", "left_anti")
        first = ended.agg(F.min("since")).first()[0]
        if first is None:
            return running
        held = self.held(events).where(F.col("batch").between(first, batch_id - 1))
        released = held.join(ended, "config_id").where(F.col("batch") >= F.col("since")).select(*events.columns)
        return running.unionByName(released)

    def held(self, like: DataFrame) -> DataFrame:
        """All events that were ever held, with their batch; ``like`` has their columns."""
        schema = like.select("*", F.lit(0).cast("bigint").alias("batch")).schema
        folders = committed_folders(self.spark, f"{self.path}/held/batch=*")
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/held")
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def waiting(self, like: DataFrame, batch_id: int) -> DataFrame:
        """Events that are still held after a batch."""
        paused = self._paused_before(batch_id + 1)
        held = self.held(like).where(F.col("batch") <= batch_id).join(paused, "config_id")
        return held.where(F.col("batch") >= F.col("since")).select(*like.columns)
