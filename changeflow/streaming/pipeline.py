"""The change pipeline: decode or parse, validate, route, transform, apply, count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changeflow.functions.keys import row_key_of_map
from changeflow.operators import apply, status
from changeflow.operators.metrics import bucket_counts
from changeflow.operators.quality import PASS, map_field, validate_many, violation_rows, with_route
from changeflow.operators.transform import transform_payload
from changeflow.schemas import Rule, Transform
from changeflow.session import committed_folders
from changeflow.sources import messages, metadata
from changeflow.streaming.held import Held
from changeflow.streaming.targets import Target

STATE = "config_id string, consumer_group string, last_seq long, records_processed_total long, status string, updated_at timestamp"
FAILURE = "config_id string, consumer_group string, status string, error_message string"
# An error message is a note for lists; the log has the whole.
ERROR_CHARS = 2000


@dataclass
class Settings:
    """What a pipeline checks and rewrites; read anew for every batch."""

    config_id: str = ""
    rules: list[Rule] = field(default_factory=list)
    transforms: list[Transform] = field(default_factory=list)
    quarantine_blocks: bool = True
    mask_violations: bool = True


def checked(events: DataFrame, settings: Settings) -> DataFrame:
    """Events with violations, route and transformed payload. Rules see the raw values."""
    validated = validate_many(
        events, settings.rules, row_key_of_map(F.col("key")), F.col("seq"), settings.config_id,
        field=map_field, present=F.col("after").isNotNull(),
        masks=settings.transforms if settings.mask_violations else (),
    )
    return transform_payload(with_route(validated, settings.quarantine_blocks), settings.transforms)


def keyed_payload(events: DataFrame, key_columns: list[str], columns: list[str] | None) -> DataFrame:
    """Key parts as columns, and the payload either as columns or as the map ``after``."""
    keys = [F.try_element_at("key", F.lit(k)).alias(k) for k in key_columns]
    if columns is None:
        return events.select(*keys, "after", "op", "ts_ms", "seq")
    payload = [F.try_element_at("after", F.lit(c)).alias(c) for c in columns if c not in key_columns]
    return events.select(*keys, *payload, "op", "ts_ms", "seq")


@dataclass
class Pipeline:
    """Applies micro-batches of events to a target and keeps side outputs by batch id.

    ``columns`` are the payload columns of a replace target; None feeds a patch target. ``spread`` deals the messages of
    a batch over that many tasks for each partition of the source; 0 leaves them as the source splits them. With
    ``compact_every`` the target is compacted after every so many batches. Side outputs are violations, held, skipped, counts, latency (bucket counts of the time
    from change to apply), state and errors; a repeated batch replaces its own. ``commands`` gives the switches known at a
    batch: while the pipeline's config is paused, its events are held, and the first batch after the pause applies them.
    """

    target: Target
    side_path: str
    settings: Callable[[], Settings]
    columns: list[str] | None = None
    spread: int = 0
    compact_every: int = 0
    consumer_group: str = "target"
    commands: Callable[[int], DataFrame] | None = None

    def process(self, events: DataFrame, batch_id: int) -> None:
        """Apply one batch. An error stops the query, and the batch is replayed from its checkpoint."""
        settings = self.settings()
        if self.commands is not None:
            named = events.withColumn("config_id", F.lit(settings.config_id))
            held = Held(self.target.spark, f"{self.side_path}/pause")
            events = held.split(named, self.commands(batch_id), batch_id).drop("config_id")
        rows = checked(events, settings).persist()
        try:
            where = messages.positions(rows.columns)
            passed = rows.where(F.col("route") == PASS)
            applied = apply.effective(passed)
            self.target.apply(keyed_payload(applied, self.target.key_columns, self.columns), batch_id)
            self._side(self._latency(applied), "latency", batch_id)
            if settings.rules:
                self._side(violation_rows(rows), "violations", batch_id)
                held = rows.where(F.col("route") != PASS)
                self._side(held.select("route", "key", "after", "op", "ts_ms", "seq", *where), "held", batch_id)
            self._side(apply.op_counts(passed, ["table"]), "counts", batch_id)
            skipped = apply.ineffective(passed).select("table", "key", "after", "op", "ts_ms", "seq", *where)
            self._side(skipped, "skipped", batch_id)
            if self.compact_every and (batch_id + 1) % self.compact_every == 0:
                self.target.compact()
            self._side(self._advanced(rows, settings.config_id, batch_id), "state", batch_id)
        except Exception as error:
            self._side(self._failure(settings.config_id, error), "errors", batch_id)
            raise
        finally:
            rows.unpersist()

    def _latency(self, applied: DataFrame) -> DataFrame:
        elapsed = F.unix_millis(F.current_timestamp()) - F.col("ts_ms")
        samples = applied.select("table", elapsed.alias("latency_ms"))
        return samples.groupBy("table").agg(*bucket_counts("latency_ms"), F.max("latency_ms").alias("max"))

    def _batches(self, name: str) -> dict[int, str]:
        """Finished folders of a side output by batch id."""
        folders = committed_folders(self.target.spark, f"{self.side_path}/{name}/batch=*")
        return {int(f.rsplit("=", 1)[1]): f for f in folders}

    def _state_before(self, batch_id: int | None = None) -> tuple[int, DataFrame]:
        """The newest state before a batch, with the batch it stands for; -1 and no rows if there is none."""
        spark = self.target.spark
        if batch_id:
            # The batch before, without a look at all others.
            folder = f"{self.side_path}/state/batch={batch_id - 1}"
            if committed_folders(spark, folder):
                return batch_id - 1, spark.read.schema(STATE).parquet(folder)
        found = {n: f for n, f in self._batches("state").items() if batch_id is None or n < batch_id}
        if not found:
            return -1, spark.createDataFrame([], STATE)
        return max(found), spark.read.schema(STATE).parquet(found[max(found)])

    def _advanced(self, rows: DataFrame, config_id: str, batch_id: int) -> DataFrame:
        """State after a batch. It starts from the batches before, so that a repeated batch counts once."""
        batch = rows.select(F.lit(config_id).alias("config_id"), F.lit(self.consumer_group).alias("consumer_group"), "seq",
                            F.timestamp_millis("ts_ms").alias("at"))
        before = self._state_before(batch_id)[1]
        if self.commands is None:
            return status.advance_state(before, batch, only_newer=False)
        commands = self.commands(batch_id)
        known = self.commands(batch_id - 1) if batch_id else commands.limit(0)
        after = status.advance_state(status.restarted(before, commands, known), batch, only_newer=False)
        return status.with_pauses(after, commands)

    def _failure(self, config_id: str, error: Exception) -> DataFrame:
        row = [(config_id, self.consumer_group, "error", str(error)[:ERROR_CHARS])]
        return self.target.spark.createDataFrame(row, FAILURE)

    def state(self) -> DataFrame:
        """Stream state after the newest batch, with status and message of the error if a later one failed."""
        at, state = self._state_before()
        failed = {n: f for n, f in self._batches("errors").items() if n > at}
        if not failed:
            return state.withColumn("error_message", F.lit(None).cast("string"))
        key = ["config_id", "consumer_group"]
        errors = self.target.spark.read.schema(FAILURE).parquet(failed[max(failed)]).withColumnRenamed("status", "_failed")
        joined = state.join(errors, key, "full_outer").withColumn("status", F.coalesce("_failed", "status"))
        return joined.select(*state.columns, "error_message")

    def _side(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.side_path}/{name}/batch={batch_id}")

    def side_output(self, name: str) -> DataFrame:
        return self.target.spark.read.parquet(f"{self.side_path}/{name}")


def spread_out(texts: DataFrame, spread: int) -> DataFrame:
    """Messages dealt over ``spread`` tasks for each partition of their source; 0 leaves them as the source splits them.

    A source bounds its partitions, so tasks grow in number and not in size, and a small batch has few of them.
    """
    return texts.repartition(spread * max(1, texts.rdd.getNumPartitions())) if spread else texts


def _parsed(batch: DataFrame, value: str, spread: int) -> DataFrame:
    texts = spread_out(batch.select(value, *messages.positions(batch.columns)), spread)
    return messages.parse(texts, value).persist()


def parsed_batches(pipeline: Pipeline, value: str = "value") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over JSON messages; bad ones go to ``dead_letters``.

    Partition and offset of a message, where the source has them, stay with it in all outputs that hold messages.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = _parsed(batch, value, pipeline.spread)
        try:
            dead = messages.dead_letters(parsed, [value, *messages.positions(parsed.columns)])
            pipeline._side(dead, "dead_letters", batch_id)
            pipeline.process(messages.good_events(parsed).drop(value), batch_id)
        finally:
            parsed.unpersist()

    return run


def routed_batches(routes: dict[str, Pipeline], side_path: str, value: str = "value",
                   spread: int = 0) -> Callable[[DataFrame, int], None]:
    """The same for a stream of many tables: messages are parsed once, each table has its pipeline.

    Events of a table without a pipeline are kept with the dead letters.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = _parsed(batch, value, spread)
        try:
            lost = F.when(~F.col("table").isin(list(routes)), F.lit("no pipeline for table"))
            known = parsed.withColumn("parse_error", F.coalesce("parse_error", lost))
            dead = messages.dead_letters(known, [value, *messages.positions(known.columns)])
            dead.write.mode("overwrite").parquet(f"{side_path}/dead_letters/batch={batch_id}")
            good = messages.good_events(known).drop(value)
            for table, flow in routes.items():
                flow.process(good.where(F.col("table") == table), batch_id)
        finally:
            parsed.unpersist()

    return run


def settings_from_tables(read: Callable[[], tuple[DataFrame, DataFrame]], config_id: str) -> Callable[[], Settings]:
    """Settings read anew for every batch; ``read`` gives the rule and the transform table."""
    def settings() -> Settings:
        rules, transforms = read()
        return Settings(config_id, metadata.load_rules(rules, config_id), metadata.load_transforms(transforms, config_id))

    return settings


def start(source: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str,
          every: str | None = "5 seconds") -> StreamingQuery:
    """Start a query; ``every=None`` takes what is there and stops."""
    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def replay(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


