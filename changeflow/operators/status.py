"""Stream configs, state and control commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.session import lookup_join


def active_configs(configs: DataFrame) -> DataFrame:
    """Configs whose changes are polled."""
    return configs.where(
        F.col("is_enabled") & F.col("trigger_deployed") & (F.col("replication_mode") == "cdc")
    )


def latest_by(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of every group."""
    rest = [c for c in rows.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return rows.groupBy(*by).agg(best).select(*by, "_best.*")


def paused_configs(commands: DataFrame) -> DataFrame:
    """Configs whose last switch was a pause; resume and restart both end one."""
    switches = commands.where(F.col("command").isin("pause", "resume", "restart"))
    last = latest_by(switches, ["config_id"], ["issued_at", "command_id"])
    return last.where(F.col("command") == "pause").select("config_id")


def restarted(state: DataFrame, commands: DataFrame, known: DataFrame) -> DataFrame:
    """State whose position is 0 again for configs that a restart among the new ``commands`` names; ``known`` are old ones."""
    fresh = commands.where(F.col("command") == "restart").join(known.select("command_id"), "command_id", "left_anti")
    named = fresh.select("config_id").distinct().withColumn("_restart", F.lit(True))
    return state.join(named, "config_id", "left").withColumn(
        "last_seq", F.when(F.col("_restart"), F.lit(0)).otherwise(F.col("last_seq")).cast("bigint")).select(*state.columns)


def with_pauses(state: DataFrame, commands: DataFrame) -> DataFrame:
    """State in which paused configs say so, and those no longer paused are active again."""
    paused = paused_configs(commands).withColumn("_paused", F.lit(True))
    status = F.when(F.col("_paused"), "paused").when(F.col("status") == "paused", "active").otherwise(F.col("status"))
    return state.join(paused, "config_id", "left").withColumn("status", status).select(*state.columns)


def without_paused(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """Rows of configs that are not paused. The paused set is one row per config."""
    return lookup_join(rows, paused_configs(commands), ["config_id"], "left_anti")


def start_positions(state: DataFrame, commands: DataFrame) -> DataFrame:
    """Last applied sequence per config; a restart after that state was written sets it to 0."""
    newest = latest_by(state, ["config_id"], ["updated_at"])
    restarts = commands.where(F.col("command") == "restart").groupBy("config_id").agg(
        F.max("issued_at").alias("_restart")
    )
    restarted = F.coalesce(F.col("_restart") >= F.col("updated_at"), F.lit(False))
    return newest.join(restarts, "config_id", "left").select(
        "config_id", F.when(restarted, F.lit(0)).otherwise(F.col("last_seq")).cast("bigint").alias("last_seq")
    )


def stream_lag_view(state: DataFrame, configs: DataFrame) -> DataFrame:
    """State rows with the topic of their config, ``unknown`` where the config is gone."""
    topics = configs.select("config_id", "kafka_topic")
    joined = lookup_join(state, topics, ["config_id"], "left")
    return joined.withColumn("topic", F.coalesce("kafka_topic", F.lit("unknown"))).drop("kafka_topic")


def stream_metrics(state: DataFrame, metrics: DataFrame, newest: int = 100) -> DataFrame:
    """Newest latency rows of streams that have state; equal times are ordered by all other columns."""
    known = state.select("config_id").distinct()
    first = ["config_id", "target_type"]
    rest = [c for c in metrics.columns if c not in (*first, "window_end")]
    return metrics.join(known, "config_id", "left_semi").orderBy(F.desc("window_end"), *first, *rest).limit(newest)


def status_code(status: Column, paused: Column | None = None) -> Column:
    """1 running, 0 paused, -1 in error."""
    code = F.when(status == "error", -1).when(status == "paused", 0).otherwise(1)
    return code if paused is None else F.when(paused, 0).otherwise(code)


def advance_state(state: DataFrame, batch: DataFrame, only_newer: bool = True) -> DataFrame:
    """Stream state after a batch: highest sequence, added record count, active status.

    ``batch``: config_id, consumer_group, seq, at. Only rows beyond the stored sequence count, so that a replayed batch
    changes nothing. A caller that gives the state of the batches before may count all rows, late ones too.
    """
    key = ["config_id", "consumer_group"]
    fresh = batch
    if only_newer:
        known = state.select(*key, F.col("last_seq").alias("_known"))
        fresh = batch.join(known, key, "left").where(F.col("_known").isNull() | (F.col("seq") > F.col("_known")))
    moved = fresh.groupBy(*key).agg(
        F.max("seq").alias("_seq"), F.count("*").alias("_n"), F.max("at").alias("_at")
    )
    joined = state.join(moved, key, "full_outer")
    return joined.select(
        *key,
        F.greatest("last_seq", "_seq").alias("last_seq"),
        (F.coalesce("records_processed_total", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(
            "records_processed_total"),
        F.when(F.col("_n").isNotNull(), F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.greatest("updated_at", "_at").alias("updated_at"),
    )


def last_offset(state: DataFrame, config_id: str, consumer_group: str) -> DataFrame:
    return state.where(
        (F.col("config_id") == config_id) & (F.col("consumer_group") == consumer_group)).select("last_seq")


def resolve(violations: DataFrame, resolved: DataFrame, key: str = "violation_id") -> DataFrame:
    """Mark violations as resolved."""
    done = resolved.select(key).distinct().withColumn("_done", F.lit(True))
    marked = violations.join(done, key, "left")
    return marked.withColumn("resolved", F.col("resolved") | F.col("_done").isNotNull()).select(*violations.columns)
