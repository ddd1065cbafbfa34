"""Keyed apply: last change per key, replace merge, patch merge, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.schemas import META_OP, META_SEQ, META_TS, META_UPDATED
from changeflow.session import same_join


def effective(changes: DataFrame, after: str | None = "after") -> DataFrame:
    """Deletes, and inserts and updates that carry fields; other rows change nothing."""
    upsert = F.col("op").isin("I", "U")
    if after is not None:
        upsert = upsert & F.col(after).isNotNull()
    return changes.where((F.col("op") == "D") | upsert)


def ineffective(changes: DataFrame, after: str | None = "after") -> DataFrame:
    """The rows that ``effective`` leaves out: unknown operations, and upserts without fields."""
    upsert = F.col("op").isin("I", "U")
    if after is not None:
        upsert = upsert & F.col(after).isNotNull()
    return changes.where(~F.coalesce((F.col("op") == "D") | upsert, F.lit(False)))


def _precedence(order: str) -> Column:
    """What makes a change win: its sequence, or being an upsert when deletes run first."""
    if order == "deletes_first":
        return F.struct((F.col("op") != "D").cast("int"), F.col("seq"))
    if order != "seq":
        raise ValueError(f"unknown order {order!r}")
    return F.col("seq")


def latest_change(changes: DataFrame, key_columns: list[str], order: str = "seq") -> DataFrame:
    """The winning change of every key.

    ``max_by`` combines on the map side, so a hot key sends one row per task and not its history.
    """
    rest = [c for c in changes.columns if c not in key_columns]
    best = F.max_by(F.struct(*rest), _precedence(order)).alias("_best")
    return changes.groupBy(*key_columns).agg(best).select(*key_columns, "_best.*")


def current_state(changes: DataFrame, key_columns: list[str], order: str = "seq") -> DataFrame:
    """Live rows after applying a change stream to an empty target."""
    return latest_change(changes, key_columns, order).where(F.col("op") != "D")


def with_meta(changes: DataFrame, updated_ms: Column | None = None) -> DataFrame:
    """Rename op, ts_ms and seq to the target's meta columns; optionally add the time of writing."""
    rows = changes.withColumnsRenamed({"op": META_OP, "ts_ms": META_TS, "seq": META_SEQ})
    return rows if updated_ms is None else rows.withColumn(META_UPDATED, updated_ms)


def payload_columns(columns: list[str], key_columns: list[str]) -> list[str]:
    """Columns an update sets: everything but key and meta columns."""
    return [c for c in columns if c not in key_columns and c not in (META_OP, META_TS, META_SEQ)]


def merge_replace(
    target: DataFrame,
    changes: DataFrame,
    key_columns: list[str],
    order: str = "seq",
    guard: bool = True,
    keep_deleted: bool = False,
    null_keys: bool = True,
) -> DataFrame:
    """New state of a target after a batch of changes that replace whole rows.

    ``target`` has key, payload and meta columns; ``changes`` has key and payload columns plus
    op, ts_ms, seq. With ``guard`` a change older than the stored row is ignored, which makes a
    replay harmless. Payload columns missing from one side are null there. Both join sides hold
    one row per key, and a null key part equals another; ``null_keys=False`` says that there is
    none, which lets the join use buckets of the target.
    """
    batch = with_meta(latest_change(changes, key_columns, order))
    payload = list(dict.fromkeys(payload_columns(target.columns + batch.columns, key_columns)))
    columns = [*payload, META_OP, META_TS, META_SEQ]

    def pack(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        types = {f.name: f.dataType for f in [*other.schema.fields, *df.schema.fields]}
        row = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in columns]
        return df.select(*key_columns, F.struct(*row).alias(name))

    both = same_join(pack(target, batch, "_tgt"), pack(batch, target, "_src"), key_columns, "full_outer", null_keys)
    newer = F.col(f"_src.{META_SEQ}") > F.col(f"_tgt.{META_SEQ}") if guard else F.lit(True)
    take = F.col("_src").isNotNull() & (F.col("_tgt").isNull() | F.coalesce(newer, F.lit(True)))
    merged = both.select(*key_columns, F.when(take, F.col("_src")).otherwise(F.col("_tgt")).alias("_row"))
    state = merged.select(*key_columns, "_row.*")
    return state if keep_deleted else state.where(F.col(META_OP) != "D")


def survivors_and_upserts(target: DataFrame, changes: DataFrame, key_columns: list[str]) -> DataFrame:
    """The same state as an unguarded merge, as untouched rows plus the batch's upserts."""
    batch = with_meta(latest_change(changes, key_columns))
    survivors = same_join(target, batch.select(*key_columns), key_columns, "left_anti")
    return survivors.unionByName(batch.where(F.col(META_OP) != "D"), allowMissingColumns=True)


def patch_entries(changes: DataFrame, key_columns: list[str], after: str = "after") -> DataFrame:
    """Changes as field entries: key, field, value, seq, ts_ms, op.

    Every change also gives one entry without a field, which keeps the key alive (or marks its
    delete) even when no field came along.
    """
    rows = effective(changes, after)
    entry = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    fields = F.when(F.col("op") != "D", F.transform(F.map_entries(after), lambda e: F.struct(
        e["key"].alias("field"), e["value"].alias("value"))))
    entries = F.concat(F.array(entry), F.coalesce(fields, F.array().cast("array<struct<field:string,value:string>>")))
    exploded = rows.select(*key_columns, F.explode(entries).alias("_e"), "seq", "ts_ms", "op")
    return exploded.select(*key_columns, "_e.field", "_e.value", "seq", "ts_ms", "op")


def fold_entries(entries: DataFrame, key_columns: list[str]) -> DataFrame:
    """Newest entry per key and field, with the newest delete kept per key.

    Folding folded entries again with more entries gives the same as folding all at once.
    """
    marker = F.when(F.col("field").isNull(), F.col("op") == "D")
    newest = F.max_by(F.struct("value", "seq", "ts_ms", "op"), "seq").alias("_e")
    rows = entries.withColumn("_delete", F.coalesce(marker, F.lit(False)))
    folded = rows.groupBy(*key_columns, "field", "_delete").agg(newest)
    return folded.select(*key_columns, "field", "_e.*")


def documents_from_entries(folded: DataFrame, key_columns: list[str]) -> DataFrame:
    """Documents from folded entries: fields written after the key's last delete."""
    is_marker = F.col("field").isNull()
    deleted = F.max(F.when(is_marker & (F.col("op") == "D"), F.col("seq")))
    alive = F.max_by(
        F.struct("seq", "ts_ms", "op"), F.when(is_marker & (F.col("op") != "D"), F.col("seq"))
    )
    entry = F.when(~is_marker, F.struct("field", "value", "seq"))
    per_key = folded.groupBy(*key_columns).agg(
        deleted.alias("_deleted"), alive.alias("_last"), F.collect_list(entry).alias("_entries")
    )
    floor = F.coalesce(F.col("_deleted"), F.lit(-1))
    live = F.filter("_entries", lambda e: e["seq"] > floor)
    document = F.map_from_entries(F.transform(F.array_sort(live), lambda e: F.struct(e["field"], e["value"])))
    return per_key.where(F.col("_last.seq") > floor).select(
        *key_columns,
        document.alias("document"),
        F.col("_last.op").alias(META_OP),
        F.col("_last.ts_ms").alias(META_TS),
        F.col("_last.seq").alias(META_SEQ),
    )


def without_hidden(folded: DataFrame, key_columns: list[str]) -> DataFrame:
    """Folded entries but for those that their key's last delete hides; once they are gone, the delete may go too."""
    is_delete = F.col("field").isNull() & (F.col("op") == "D")
    last = F.max(F.when(is_delete, F.col("seq"))).over(Window.partitionBy(*key_columns))
    marked = folded.withColumn("_deleted", last)
    return marked.where(is_delete | F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted"))).drop("_deleted")


def merge_patch(entries: DataFrame, changes: DataFrame, key_columns: list[str], after: str = "after") -> DataFrame:
    """Folded entries after a batch that sets single fields; absent fields survive."""
    return fold_entries(entries.unionByName(patch_entries(changes, key_columns, after)), key_columns)


def op_counts(changes: DataFrame, by: list[str], after: str | None = "after") -> DataFrame:
    """Inserts, updates, deletes, applied and skipped rows per group."""
    upsert = F.col("op").isin("I", "U")
    usable = upsert if after is None else upsert & F.col(after).isNotNull()
    applied = usable | (F.col("op") == "D")
    return changes.groupBy(*by).agg(
        F.count_if(usable & (F.col("op") == "I")).alias("inserted"),
        F.count_if(usable & (F.col("op") == "U")).alias("updated"),
        F.count_if(F.col("op") == "D").alias("deleted"),
        F.count_if(applied).alias("applied"),
        F.count_if(~F.coalesce(applied, F.lit(False))).alias("skipped"),
    )


def reconcile(source: DataFrame, target: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Row counts and an order-free content hash of two tables, side by side.

    A row's hash holds each column's place and whether it is null. The hashes are combined both by xor and by sum, as
    equal rows cancel in an xor.
    """
    parts = [p for i, c in enumerate(columns) for p in (F.lit(i), F.col(c).isNull(), F.col(c))]

    def digest(df: DataFrame, side: str) -> DataFrame:
        row = df.select(*by, F.xxhash64(*parts).alias("_hash"))
        return row.groupBy(*by).agg(
            F.count("*").alias(f"{side}_rows"),
            F.struct(F.bit_xor("_hash"), F.sum(F.col("_hash").cast("decimal(28,0)"))).alias(f"{side}_hash"),
        )

    both = same_join(digest(source, "source"), digest(target, "target"), by, "full_outer")
    rows = {s: F.coalesce(F.col(f"{s}_rows"), F.lit(0)) for s in ("source", "target")}
    same = (rows["source"] == rows["target"]) & F.col("source_hash").eqNullSafe(F.col("target_hash"))
    return both.select(
        *by, rows["source"].alias("source_rows"), rows["target"].alias("target_rows"), same.alias("matches")
    )
