"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most three bits differ in at most one bit of one of their two halves. Each half is indexed
32 times, each time without one of its bits; two such fingerprints then share a variant, which an equality match finds
and the full distance verifies. Only distinct fingerprints are indexed, and a bucket gives the links of a spanning
forest, so copies and dense groups don't multiply. A large bucket is split by the same variants of the other half, in
quarters; what then shares a bucket differs in at most 18 known bits, so its neighbours can be enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import append_columns, field, prepared, stored, texts

SHINGLE = 3
DISTANCE = 3
SEED = 42
HALF, QUARTER = 32, 16
# What tells rows apart, whatever their keys.
TEXT_HASH, ROW_HASH = "__text_hash", "__row_hash"
# Members of a bucket that are compared directly.
DIRECT = 1024


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(n, shingle)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)),
        np.uint64, n - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """All columns of ``df`` and the fingerprint of each row's whole text; no shuffle."""
    return append_columns(df, [field(name, "long")], lambda b: [[fingerprint(t, shingle) for t in texts(b, text)]])


def _without_bit(part: np.ndarray, bit: int) -> np.ndarray:
    bit = np.uint64(bit)
    return (part >> (bit + np.uint64(1)) << bit) | (part & ((np.uint64(1) << bit) - np.uint64(1)))


def variants(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, 64): each half without each of its bits, with the half and bit in front."""
    u = fps.view(np.uint64)
    out = np.empty((len(u), 2 * HALF), np.uint64)
    for half in range(2):
        part = (u >> np.uint64(HALF * half)) & np.uint64(2**HALF - 1)
        for bit in range(HALF):
            out[:, half * HALF + bit] = np.uint64(half * HALF + bit) << np.uint64(HALF - 1) | _without_bit(part, bit)
    return out.view(np.int64)


def finer(fps: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(members, 32): for members of large buckets, the bucket with a variant of a quarter of the other half."""
    u, k = fps.view(np.uint64), keys.view(np.uint64)
    other = np.uint64(1) - (k >> np.uint64(HALF - 1)) // np.uint64(HALF)
    rest = (u >> (other * np.uint64(HALF))) & np.uint64(2**HALF - 1)
    out = np.empty((len(u), 2 * QUARTER), np.uint64)
    for quarter in range(2):
        part = (rest >> np.uint64(QUARTER * quarter)) & np.uint64(2**QUARTER - 1)
        for bit in range(QUARTER):
            place = np.uint64(quarter * QUARTER + bit) << np.uint64(QUARTER - 1)
            out[:, quarter * QUARTER + bit] = k << np.uint64(20) | place | _without_bit(part, bit)
    return out.view(np.int64)


def _forest_direct(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each member the smallest index it can reach; every pair is compared."""
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= distance
    label = np.arange(len(u))
    while True:
        new = np.where(near, label[None, :], len(u)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _forest_by_neighbours(fps: np.ndarray, distance: int) -> np.ndarray:
    """The same where members differ in few bits: all places within the distance are looked up."""
    u = fps.view(np.uint64)
    spread = int(np.bitwise_or.reduce(u ^ u[0]))
    bits = [b for b in range(64) if spread >> b & 1]
    place = np.zeros(len(u), np.int64)
    for i, b in enumerate(bits):
        place |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    member = np.full(1 << len(bits), -1, np.int64)
    member[place] = np.arange(len(u))
    masks = [sum(1 << i for i in c) for d in range(1, distance + 1) for c in combinations(range(len(bits)), d)]
    label = np.arange(len(u))
    while True:
        new = label.copy()
        for mask in masks:
            other = member[place ^ mask]
            has = np.flatnonzero(other >= 0)
            new[has] = np.minimum(new[has], label[other[has]])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all whole buckets in rows sorted by (key, fingerprint): each member with the smallest that it reaches."""
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    near = np.bitwise_count(fps[two].view(np.uint64) ^ fps[two + 1].view(np.uint64)) <= distance
    a, b = [fps[two + 1][near]], [fps[two][near]]
    for start, size in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = fps[start:start + size]
        label = _forest_direct(own, distance) if size <= DIRECT else _forest_by_neighbours(own, distance)
        moved = np.flatnonzero(label != np.arange(size))
        a.append(own[moved])
        b.append(own[label[moved]])
    return np.concatenate(a), np.concatenate(b)


def _indexed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(variants(fp).ravel()), pa.array(np.repeat(fp, 2 * HALF))], names=["key", "fp"])

    return prepared(fps).mapInArrow(run, "key long, fp long")


def _indexed_finer(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(finer(fp, key).ravel()), pa.array(np.repeat(fp, 2 * QUARTER))], names=["key", "fp"])

    return members.mapInArrow(run, "key long, fp long")


def _matched(indexed: DataFrame, distance: int, direct: int | None) -> DataFrame:
    """Bucket by bucket: rows with ``b`` are links; rows without are members of buckets over ``direct``, unmatched yet.

    The equality join on the variant is a shuffle by key; its buckets pass as sorted rows, and of one at most ``direct``
    members are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, key):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

        def unmatched(k, f):
            return rows(f, [None] * len(f), k)

        keys = fps = np.zeros(0, np.int64)
        large = None
        for batch in batches:
            k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if large is not None:
                n = int(np.searchsorted(k, large, side="right"))
                if n:
                    yield unmatched(k[:n], f[:n])
                    k, f = k[n:], f[n:]
                if not len(k):
                    continue
                large = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            last = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            done_k, done_f, keys, fps = keys[:last], fps[:last], keys[last:], fps[last:]
            if direct and len(keys) > direct:
                yield unmatched(keys, fps)
                large, keys, fps = keys[-1], keys[:0], fps[:0]
            yield from whole(done_k, done_f, rows, unmatched)
        yield from whole(keys, fps, rows, unmatched)

    def whole(keys, fps, rows, unmatched):
        if direct and len(keys):
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            over = np.repeat(np.diff(bounds) > direct, np.diff(bounds))
            if over.any():
                yield unmatched(keys[over], fps[over])
                keys, fps = keys[~over], fps[~over]
        if len(keys):
            a, b = _bucket_links(keys, fps, distance)
            if len(a):
                yield rows(a, b, np.full(len(a), -1))

    dealt = indexed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long, key long")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) with a > b: links of distinct fingerprints that keep every connection within ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one wildcard serve distances up to 3")
    found = stored(_matched(_indexed(fps), distance, DIRECT), "simhash-links")
    rest = found.filter("b IS NULL").select("key", F.col("a").alias("fp"))
    more = _matched(_indexed_finer(rest), distance, None)
    return found.filter("b IS NOT NULL").select("a", "b").unionByName(more.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating star contractions.

    A round points each node's larger neighbours, then its smaller ones, at its smallest. Nodes are aggregated before
    they are joined, and each round is a stored table.
    """
    edges = stored(edges, "simhash-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"),
                                            F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a > b").distinct(), "simhash-edges")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.xxhash64("a", "b").cast("string").cast("binary")))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): one row for each row of ``df``.

    ``component_id`` is the smallest key among rows whose fingerprints are linked through steps of at most ``distance``
    bits. Rows without words have fingerprint zero and are linked with one another. Null keys are grouped but never name
    a component (null if a component has no other); repeated rows stay. Other columns of ``df`` are left out. An empty
    table gives no rows.
    """
    rows = stored(with_fingerprint(df.select(key, text), text, shingle).select(F.col(key).alias("k"), "fp"), "simhash-rows")
    single = rows.groupBy("fp").agg(F.min("k").alias("least"))
    roots = components(links(single.select("fp"), distance))
    named = single.join(roots, single["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    named = stored(named, "simhash-roots")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(of, "fp").select(F.col("k").alias(key), digits.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The columns of ``df``, exactly one row of each group of near-duplicates: that with the smallest key.

    Groups are those of the fingerprints, whatever the keys: rows that share a key but not a text are not copies, and
    rows without a key are compared like others and come last in their group. Of rows with one key, the smallest
    fingerprint, then the hashes of text and row decide; of rows that are the same in all columns one stays.
    """
    # Maps have no hash of their own.
    shown = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields]
    whole = F.xxhash64(*shown, *[F.col(c).isNull() for c in df.columns])
    marked = df.withColumns({TEXT_HASH: F.xxhash64(text), ROW_HASH: whole})
    prints = with_fingerprint(marked.select(key, text, TEXT_HASH, ROW_HASH), text, name="__fp")
    rows = stored(prints.select(F.col(key).alias("k"), F.col("__fp").alias("fp"), TEXT_HASH, ROW_HASH), "simhash-rows")
    order = F.struct(F.col("k").isNull().alias("last"), "k", "fp", TEXT_HASH, ROW_HASH)
    single = rows.groupBy("fp").agg(F.min(order).alias("first"))
    roots = components(links(single.select("fp"), distance))
    named = single.join(roots, single["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "first")
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(f"first.{TEXT_HASH}", f"first.{ROW_HASH}")
    kept = marked.join(chosen, [TEXT_HASH, ROW_HASH], "left_semi").dropDuplicates([TEXT_HASH, ROW_HASH])
    return kept.select(*df.columns)
