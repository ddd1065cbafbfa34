"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, which is then rendered.

The hash of a conversation's first turns combines position-bound hashes of the turns, so that prefixes of all lengths
come from running combinations, also across blocks of one very long conversation. A conversation is a snapshot if another
has its hash as that of a proper prefix; an anti-join leaves the others, and of equal ones the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import stored

# Turns of a conversation that one task orders, and that one rendered row holds.
BLOCK = 512
# Characters of a text that bounds of ranges may hold.
HEAD = 64
START, END = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, h1, h2): turns numbered from 0 by turn number, then by role and text.

    Exact repeats of a turn count once. Null turn numbers come first; a null role is ``unknown``, a null text empty. All
    turns are put in one order by sampled ranges, whatever conversations and numbers they have, so that no conversation has
    to be ordered in one task, not even the one of all rows without conv_id or without numbers.
    """
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    # Bounds are sampled from the first characters of texts only.
    ranges = clean.withColumn("head", F.left("text", F.lit(HEAD))).repartitionByRange("conv_id", "turn", "role", "head").drop("head")
    ordered = ranges.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id())
    placed = stored(ordered, "chat-places").withColumn("range", F.shiftright("place", 33))
    # A row for each range and conversation: how many turns of it come before, and where it begins.
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("place").alias("begin")).select(
        F.col("conv_id").alias("c"), F.col("range").alias("r"), "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    met = placed.join(parts, placed["conv_id"].eqNullSafe(parts["c"]) & (placed["range"] == parts["r"]))
    position = F.col("first") + F.col("place") - F.col("begin")
    return met.select(
        "conv_id", position.alias("position"), "role", "text",
        F.xxhash64(F.lit(1), position, "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), F.reverse("text"), position, "role").alias("h2"))


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2): for each turn, the hash pair of the ``n`` turns up to it."""
    rows = numbered.select("conv_id", "position", "h1", "h2", F.floor(F.col("position") / BLOCK).alias("block"))
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    within = Window.partitionBy("conv_id", "block").orderBy("position")
    running = rows.select("conv_id", "block", "position", *[F.bit_xor(f"h{i}").over(within).alias(f"r{i}") for i in (1, 2)])
    joined = running.join(starts, running["conv_id"].eqNullSafe(starts["c"]) & (running["block"] == starts["b"]))
    return joined.select("conv_id", (F.col("position") + 1).alias("n"),
                         *[F.col(f"r{i}").bitwiseXOR(F.col(f"s{i}")).alias(f"p{i}") for i in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n): conversations that are no prefix of another, the smallest id of equal ones."""
    same = ["n", "p1", "p2"]
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("n", "p1", "p2"), "n").alias("w"))
    whole = last.select("conv_id", "w.*").groupBy(*same).agg(F.min("conv_id").alias("conv_id"))
    sizes = last.select(F.col("conv_id").alias("c"), F.col("w.n").alias("size"))
    inner = prefixes.join(sizes, prefixes["conv_id"].eqNullSafe(sizes["c"])).filter("n < size").select(*same).distinct()
    return whole.join(inner, same, "left_anti").select("conv_id", "n")


def render_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, part, first_turn, part_turns, text): maximal conversations as chat markup.

    A part holds up to ``BLOCK`` turns, so a conversation of any length is whole and no row grows without bound; most
    have one part. ``turns`` has conv_id, turn, role and text; other columns are left out. Rows without conv_id are one
    conversation. An empty table gives no rows.
    """
    numbered = stored(numbered_turns(turns), "chat-turns")
    kept = maximal(stored(prefix_hashes(numbered), "chat-prefixes")).select(F.col("conv_id").alias("c"), F.col("n").alias("n_turns"))
    rows = numbered.join(kept, numbered["conv_id"].eqNullSafe(kept["c"]))
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))
    parts = rows.groupBy("conv_id", "n_turns", F.floor(F.col("position") / BLOCK).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return parts.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("part").cast("long").alias("part"),
        F.col("lines")[0]["position"].cast("long").alias("first_turn"), F.size("lines").cast("long").alias("part_turns"),
        F.array_join(F.col("lines.line"), "").alias("text"))
