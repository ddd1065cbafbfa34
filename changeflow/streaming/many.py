"""One apply for the changes of all tables: one reduction and one write a batch, however many tables there are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import apply, quality, status
from changeflow.schemas import ENVELOPE, META_OP, META_SEQ, META_TS
from changeflow.session import committed_folders, same_join
from changeflow.sources import messages
from changeflow.streaming.held import Held
from changeflow.streaming.pipeline import spread_out

UNIT = ["table", "row_key"]
ROWS = "row_key string, key map<string,string>, after map<string,string>, op string, ts_ms long, seq long, batch long, `table` string"
ENTRIES = "row_key string, field string, value string, seq long, ts_ms long, op string, batch long, `table` string"
STATE = ("config_id string, consumer_group string, last_seq long, records_processed_total long, status string, "
         "updated_at timestamp")


def canonical_key(key: Column) -> Column:
    """A key map as text that tells all keys apart, whatever order the fields came in."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(key))), {"ignoreNullFields": "false"})


@dataclass
class ManyTables:
    """Applies micro-batches of events of many tables; a table is its own config.

    Changes are reduced by (table, key) with their payload as a map, so tables need no common columns. With ``patch`` a
    change sets the fields that it carries, else it replaces the row. ``rules`` gives the rule table of all tables, as
    ``quality.validate_with_table`` takes it, and ``commands`` the switches known at a batch. Side outputs are
    violations, counts and state; a repeated batch replaces its own.
    """

    spark: SparkSession
    path: str
    patch: bool = False
    rules: Callable[[], DataFrame] | None = None
    commands: Callable[[int], DataFrame] | None = None
    consumer_group: str = "target"

    def process(self, events: DataFrame, batch_id: int) -> None:
        """Apply one batch. The number of jobs doesn't depend on the number of tables."""
        rows = events.withColumns({"config_id": F.col("table"), "row_key": canonical_key(F.col("key"))})
        if self.commands is not None:
            rows = Held(self.spark, f"{self.path}/pause").split(rows, self.commands(batch_id), batch_id)
        rows = rows.persist()
        try:
            passed = rows if self.rules is None else self._checked(rows, batch_id)
            applied = apply.effective(passed)
            if self.patch:
                reduced = apply.fold_entries(apply.patch_entries(applied, UNIT), UNIT)
            else:
                reduced = apply.latest_change(applied.select(*UNIT, "key", "after", "op", "ts_ms", "seq"), UNIT)
            # Tables are brought together for the write; a large one is split again, small ones share a task.
            self._write(reduced.hint("rebalance", "table"), "changes", batch_id, "table")
            self._write(apply.op_counts(passed, ["table"]), "counts", batch_id)
            self._write(self._advanced(rows, batch_id), "state", batch_id)
        finally:
            rows.unpersist()

    def _checked(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows that no rule holds back. Violations are written first and read again, so that rules run once."""
        found = quality.validate_with_table(rows.select("config_id", "row_key", "seq", "after"), self.rules())
        self._write(found, "violations", batch_id)
        blocked = self.output("violations", batch_id).where(F.col("severity").isin(quality.REJECT, quality.QUARANTINE)).select(
            F.col("config_id").alias("table"), "row_key", F.col("event_seq").alias("seq")).distinct()
        return same_join(rows, blocked, [*UNIT, "seq"], "left_anti")

    def _advanced(self, rows: DataFrame, batch_id: int) -> DataFrame:
        batch = rows.select("config_id", F.lit(self.consumer_group).alias("consumer_group"), "seq",
                            F.timestamp_millis("ts_ms").alias("at"))
        before = self.state(batch_id - 1)
        if self.commands is None:
            return status.advance_state(before, batch, only_newer=False)
        commands = self.commands(batch_id)
        known = self.commands(batch_id - 1) if batch_id else commands.limit(0)
        after = status.advance_state(status.restarted(before, commands, known), batch, only_newer=False)
        return status.with_pauses(after, commands)

    def _write(self, rows: DataFrame, name: str, batch_id: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/batch={batch_id}")

    def output(self, name: str, batch_id: int | None = None) -> DataFrame:
        """A side output of one batch, or of all with their batch."""
        if batch_id is not None:
            return self.spark.read.parquet(f"{self.path}/{name}/batch={batch_id}")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*")

    def state(self, batch_id: int) -> DataFrame:
        """Stream state after a batch; no rows before the first."""
        folder = committed_folders(self.spark, f"{self.path}/state/batch={batch_id}")
        return self.spark.read.schema(STATE).parquet(*folder) if folder else self.spark.createDataFrame([], STATE)

    def waiting(self, batch_id: int) -> DataFrame:
        """Events that are held after a batch."""
        like = self.spark.createDataFrame([], ENVELOPE + ", config_id STRING, row_key STRING")
        return Held(self.spark, f"{self.path}/pause").waiting(like, batch_id)

    def _stored(self, table: str | None) -> DataFrame:
        folders = committed_folders(self.spark, f"{self.path}/changes/batch=*")
        schema = ENTRIES if self.patch else ROWS
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/changes").parquet(*folders)
        return rows if table is None else rows.where(F.col("table") == table)

    def read(self, table: str | None = None) -> DataFrame:
        """Live rows of one table, whose folders alone are read, or of all: table, row_key, the payload map, meta columns."""
        stored = self._stored(table).drop("batch")
        if self.patch:
            return apply.documents_from_entries(apply.fold_entries(stored, UNIT), UNIT)
        live = apply.current_state(stored, UNIT)
        return live.withColumnsRenamed({"op": META_OP, "ts_ms": META_TS, "seq": META_SEQ})


def many_tables_batches(flow: ManyTables, value: str = "value", spread: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over JSON messages of any tables; bad ones go to ``dead_letters``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = messages.parse(spread_out(batch.select(value), spread), value).persist()
        try:
            flow._write(messages.dead_letters(parsed, [value]), "dead_letters", batch_id)
            flow.process(messages.good_events(parsed).drop(value), batch_id)
        finally:
            parsed.unpersist()

    return run
