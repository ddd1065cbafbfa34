"""Alert rules: matching, cooldown and firing history; conditions that must hold for a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.times import severity_rank
from changeflow.operators.metrics import SLA_MS, histogram_quantiles, rates
from changeflow.operators.ranges import nearest, placed
from changeflow.operators.sequence import held_for
from changeflow.session import checkpointed, lookup_join, ship_package

# Accepted alert conditions.
CONDITION_TYPES = ["latency_breach", "error_rate", "consumer_down", "hana_cpu", "custom"]

_ROWS = "rule_id string, cooldown_us long, block long, entry long, leave long"
_FIRED = "rule_id string, cooldown_us long, entry long"


def matching_rules(events: DataFrame, rules: DataFrame, channels: DataFrame) -> DataFrame:
    """Events paired with the enabled rules that could fire on them.

    ``events``: event_id, at, alert_type, severity, org_id, message. ``rules``: rule_id,
    condition_type, severity_filter, channel_id, cooldown_minutes, last_fired_at, is_enabled,
    org_id. ``channels``: channel_id, is_active. An event without an org meets the rules of all.
    """
    active = channels.where("is_active").select("channel_id")
    usable = rules.where(F.col("is_enabled") & F.col("condition_type").isin(CONDITION_TYPES))
    usable = usable.join(active, "channel_id").select(
        "rule_id", F.col("condition_type").alias("alert_type"), "severity_filter", "channel_id",
        "cooldown_minutes", "last_fired_at", F.col("org_id").alias("rule_org"),
    )
    # A rule stands twice, for its own org and for events without one, so that events meet no rule of another org.
    places = F.array(F.struct(F.lit(True).alias("_every"), F.lit("").alias("_org")),
                     F.struct(F.lit(False).alias("_every"), F.col("rule_org").cast("string").alias("_org")))
    usable = usable.select("*", F.inline(places))
    placed = events.select("*", F.col("org_id").isNull().alias("_every"),
                           F.coalesce(F.col("org_id").cast("string"), F.lit("")).alias("_org"))
    pairs = lookup_join(placed, usable, ["alert_type", "_every", "_org"]).drop("_every", "_org")
    severe = F.col("severity_filter").isNull() | (
        severity_rank(F.col("severity")) >= severity_rank(F.col("severity_filter"))
    )
    return pairs.where(severe)


def _follow(entry: np.ndarray, leave: np.ndarray, cooldown: int) -> np.ndarray:
    """For each row the place of the next row that may fire; the row count when there is none."""
    return np.searchsorted(entry, leave + cooldown, side="left")


def _close_block(fan: int, level: int):
    """Reduce a block to the rows from which it can be entered, each with the last firing time."""
    def close(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entry")
        entry, leave = rows["entry"].to_numpy(), rows["leave"].to_numpy()
        cooldown, block, n = int(rows["cooldown_us"].iat[0]), int(rows["block"].iat[0]), len(rows)
        follow = _follow(entry, leave, cooldown)
        last = np.where(follow == n, np.arange(n), follow)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        # The firing before the block is older than the block's start, so its cooldown ends
        # before ``zone``: later rows can only be entered through the first of them.
        zone = block * cooldown * fan**level + cooldown
        keep = min(int(np.searchsorted(entry, zone, side="left")) + 1, n)
        return pd.DataFrame({
            "rule_id": rows["rule_id"].iat[0], "cooldown_us": cooldown, "block": block,
            "entry": entry[:keep], "leave": leave[last[:keep]],
        })

    return close


def _walk(rows: pd.DataFrame, start: int) -> pd.DataFrame:
    """The rows that fire when the walk enters at ``start``."""
    rows = rows.sort_values("entry")
    entry, leave = rows["entry"].to_numpy(), rows["leave"].to_numpy()
    follow = _follow(entry, leave, int(rows["cooldown_us"].iat[0]))
    at, fired = int(np.searchsorted(entry, start, side="left")), []
    while at < len(entry):
        fired.append(entry[at])
        at = int(follow[at])
    return pd.DataFrame({
        "rule_id": rows["rule_id"].iat[0], "cooldown_us": rows["cooldown_us"].iat[0], "entry": fired})


def _links(instants: DataFrame, rows_per_task: int) -> DataFrame:
    """(rule_id, entry, starts, jump): whether an instant fires whatever came before, and the one that fires after it.

    An instant that comes a cooldown after the one before it always fires. ``jump`` is null where the next one is such a
    start, or where there is none.
    """
    found = placed(instants.select("rule_id", "cooldown_us", "entry"), ["rule_id", "entry"], rows_per_task)
    known = nearest(found, ["rule_id"], F.col("entry"), "before", after=False)
    alone = F.coalesce(F.col("entry") - F.col("before") >= F.col("cooldown_us"), F.lit(True))
    marked = known.select("rule_id", "cooldown_us", "entry", alone.alias("starts"))
    # Instants, and the times at which their cooldown ends, just before an instant of that time.
    points = marked.select("rule_id", F.col("entry").alias("at"), F.lit(1).alias("side"), "entry", "starts").unionByName(
        marked.select("rule_id", (F.col("entry") + F.col("cooldown_us")).alias("at"), F.lit(0).alias("side"), "entry", "starts"))
    target = F.when(F.col("side") == 1, F.struct("entry", "starts"))
    ends = nearest(placed(points, ["rule_id", "at", "side", "entry"], rows_per_task), ["rule_id"], target, "next", after=True)
    jump = F.when(~F.col("next.starts"), F.col("next.entry"))
    return checkpointed(ends.where("side = 0").select("rule_id", "entry", "starts", jump.alias("jump")))


def _twice(jumps: DataFrame, rows_per_task: int) -> DataFrame:
    """Jumps of twice the length. Many instants may jump to the same one, so it is met by order and not by key."""
    points = jumps.select("rule_id", F.col("entry").alias("at"), F.lit(0).alias("side"), "entry", "jump").unionByName(
        jumps.select("rule_id", F.col("jump").alias("at"), F.lit(1).alias("side"), "entry", F.lit(None).cast("bigint").alias("jump")))
    target = F.when(F.col("side") == 0, F.struct("at", "jump"))
    met = nearest(placed(points, ["rule_id", "at", "side", "entry"], rows_per_task), ["rule_id"], target, "next", after=False)
    return checkpointed(met.where((F.col("side") == 1) & (F.col("next.at") == F.col("at"))).select(
        "rule_id", "entry", F.col("next.jump").alias("jump")))


def _by_doubling(instants: DataFrame, rows_per_task: int) -> DataFrame:
    """(rule_id, entry) that fire, for rules of any density.

    All starts fire. In each round those known to fire add the ones that their jumps reach, and jumps double, so a chain
    of n firings between two starts takes log2(n) rounds. No step gathers a rule or a cooldown: ranges of the order of
    all instants are all that a task holds.
    """
    links = _links(instants, rows_per_task)
    fired = links.where("starts").select("rule_id", "entry")
    jumps = links.where("jump IS NOT NULL").select("rule_id", "entry", "jump")
    while True:
        # Jumps keep the order of a chain, so what is reached is new and reached once.
        reached = checkpointed(fired.join(jumps, ["rule_id", "entry"]).select("rule_id", F.col("jump").alias("entry")))
        if reached.isEmpty():
            return fired
        fired = checkpointed(fired.unionByName(reached))
        jumps = _twice(jumps, rows_per_task)


def cooldown_firings(candidates: DataFrame, fan: int | None = None, levels: int | None = None,
                     rows_per_task: int = 1_000_000) -> DataFrame:
    """The candidates that fire: a rule rests for its cooldown after each firing.

    ``candidates``: rule_id, at, event_id, cooldown_minutes, last_fired_at. Firing is sequential
    per rule, so a busy rule is cut into blocks of ``fan`` cooldowns, ``fan**2`` and so on. Going
    up, each block is reduced to its possible entries; the top is walked once; going down, each
    block is walked from the entry it was reached at. The width of a block follows from the
    densest stretch and the number of levels from the busiest rule, so that no task holds many
    more than ``rows_per_task`` rows. A rule with more instants than that in one cooldown has no
    such blocks; its firings are found by jumps over ranges of instants. Of candidates at the
    same instant the lowest event_id fires; a rule without cooldown fires on all.
    """
    ship_package(candidates.sparkSession)
    at = F.unix_micros(F.col("at").cast("timestamp"))
    cooldown = F.col("cooldown_minutes").cast("bigint") * 60_000_000
    ready = F.coalesce(F.unix_micros(F.col("last_fired_at").cast("timestamp")) + cooldown, F.lit(-(2**62)))
    timed = candidates.select(
        F.col("rule_id").cast("string").alias("rule_id"), "event_id", at.alias("entry"),
        cooldown.alias("cooldown_us"), ready.alias("_ready"),
    ).where(F.col("entry") >= F.col("_ready"))
    resting = timed.where(F.col("cooldown_us") > 0)
    instants = resting.groupBy("rule_id", "cooldown_us", "entry").agg(F.min("event_id").alias("event_id"))

    # Each layer is read on the way up and again on the way down.
    instants = checkpointed(instants)
    per_window = instants.groupBy("rule_id", F.expr("entry div cooldown_us").alias("w")).agg(
        F.count("*").alias("n"))
    per_rule = per_window.groupBy("rule_id").agg(F.sum("n").alias("total"), F.max("n").alias("densest"))
    sparse = F.col("densest") <= rows_per_task
    busiest, densest, n_dense = per_rule.agg(
        F.max(F.when(sparse, F.col("total"))), F.max(F.when(sparse, F.col("densest"))), F.count_if(~sparse)).first()
    everything, found = instants, None
    if n_dense:
        dense = per_rule.where(~sparse).select("rule_id")
        found = _by_doubling(instants.join(dense, "rule_id", "left_semi"), rows_per_task)
        instants = instants.join(dense, "rule_id", "left_anti")
    if fan is None:
        fan = max(2, min(1024, rows_per_task // (densest or 1)))
    if levels is None:
        levels, left = 0, busiest or 0
        while left > rows_per_task:
            left, levels = left // fan, levels + 1

    def block(level: int, of: str) -> Column:
        return F.expr(f"{of} div (cooldown_us * {fan**level})").alias("block")

    layers = [instants.select("rule_id", "cooldown_us", "entry", F.col("entry").alias("leave"))]
    for level in range(1, levels + 1):
        rows = layers[-1].select("rule_id", "cooldown_us", block(level, "entry"), "entry", "leave")
        closed = rows.groupBy("rule_id", "block").applyInPandas(_close_block(fan, level), _ROWS).drop("block")
        layers.append(checkpointed(closed) if level < levels else closed)

    def from_first(rows: pd.DataFrame) -> pd.DataFrame:
        return _walk(rows, int(rows["entry"].min()))

    def from_entry(rows: pd.DataFrame) -> pd.DataFrame:
        return _walk(rows, int(rows["start"].iat[0]))

    fired = layers[-1].groupBy("rule_id").applyInPandas(from_first, _FIRED)
    for level in range(levels, 0, -1):
        rows = layers[level - 1].select("rule_id", "cooldown_us", block(level, "entry"), "entry", "leave")
        # A block is entered once, at a row of its own, so the block follows from the entry.
        entries = fired.select("rule_id", block(level, "entry"), F.col("entry").alias("start"))
        fired = rows.join(entries, ["rule_id", "block"]).groupBy("rule_id", "block").applyInPandas(from_entry, _FIRED)
    fired = fired.select("rule_id", "entry") if found is None else fired.select("rule_id", "entry").unionByName(found)
    chosen = everything.join(fired, ["rule_id", "entry"]).select("rule_id", "event_id")
    return chosen.unionByName(timed.where(F.col("cooldown_us") == 0).select("rule_id", "event_id"))


def alert_history(candidates: DataFrame, firings: DataFrame) -> DataFrame:
    """One row per firing, waiting for delivery."""
    rows = candidates.withColumn("rule_id", F.col("rule_id").cast("string"))
    return rows.join(firings, ["rule_id", "event_id"]).select(
        "rule_id", "channel_id", "event_id", "alert_type", "severity", "message",
        F.lit("pending").alias("delivery_status"), F.col("at").alias("fired_at"),
    )


def rules_after(rules: DataFrame, history: DataFrame) -> DataFrame:
    """The rules with the clock that the next batch starts from: the newest firing, or the old one without any."""
    fired = history.groupBy(F.col("rule_id").alias("_fired_rule")).agg(F.max("fired_at").alias("_fired"))
    joined = rules.join(fired, F.col("rule_id").cast("string") == F.col("_fired_rule"), "left")
    newest = F.greatest(F.col("last_fired_at").cast("timestamp"), F.col("_fired").cast("timestamp"))
    return joined.withColumn("last_fired_at", newest).select(*rules.columns)


def latency_breach(samples: DataFrame, by: list[str], ts: str, value: str = "latency_ms",
                   threshold: int = SLA_MS, seconds: int = 300) -> DataFrame:
    """Stretches over which the 5-minute p95 stayed above the target."""
    quantiles = histogram_quantiles(samples, by, ts, value, {"p95": 0.95})
    timed = quantiles.withColumn("at", F.timestamp_seconds("window_start_s"))
    return held_for(timed, by, "at", F.col("p95") > threshold, seconds)


def threshold_held(samples: DataFrame, by: list[str], ts: str, condition: Column, seconds: int) -> DataFrame:
    """Any sampled condition: backlog above a limit, a status of -1, source load above 70."""
    return held_for(samples, by, ts, condition, seconds)


def error_rate_held(errors: DataFrame, by: list[str], ts: str, above: float = 0.1, seconds: int = 120) -> DataFrame:
    """Stretches over which errors came faster than ``above`` per second."""
    windows = rates(errors, by, ts).withColumn("at", F.timestamp_seconds("window_start_s"))
    return held_for(windows, by, "at", F.col("per_second") > above, seconds)


def idle_streams(streams: DataFrame, events: DataFrame, by: list[str], ts: str, now: Column,
                 seconds: int = 300) -> DataFrame:
    """Active streams without one event in the last ``seconds``."""
    recent = events.where((F.col(ts) > now - F.expr(f"INTERVAL {int(seconds)} SECONDS")) & (F.col(ts) <= now))
    return streams.where(F.col("status") == "active").join(recent.select(*by).distinct(), by, "left_anti")
