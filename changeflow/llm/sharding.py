"""Sharding by a two-pass external shuffle, with DataFrame operations only.

The first pass scatters records by seeded hashes: a record's shard follows from its key and the number of shards alone
(the shard whose hash with the key is largest, so that one more shard takes records only into itself), and a hash of its
key and position puts it into one of the shard's buckets, as many as the shard's own size asks for, so that each fits in
memory. The scattered records are written. The second pass reads them, orders each bucket by Fisher-Yates and numbers the records of a shard through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import stored
from changeflow.session import shared_dir

SEED = 17
# A bucket's bytes; a task holds one bucket at a time.
BUCKET_BYTES = 32 << 20
# Records of a bucket, however small they are.
BUCKET_ROWS = 200_000
# Buckets whose first slots are broadcast; they stand for 3 TB.
BROADCAST_BUCKETS = 100_000
# Column that carries a record's bytes while it is dealt.
SIZE = "__record_bytes"


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest hash of (key, seed, shard)."""
    text = F.coalesce(key.cast("string"), F.lit("\0"))
    drawn = [F.struct(F.xxhash64(text, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*drawn))["s"] if shards > 1 else F.lit(0)


def buckets_of(placed: DataFrame, bucket_bytes: int, bucket_rows: int) -> dict[int, int]:
    """Buckets of each shard by its bytes and records; ``placed`` has shard and size, one row for each record."""
    sums = placed.groupBy("shard").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows"))
    return {r["shard"]: max(1, -(-r["bytes"] // bucket_bytes), -(-r["rows"] // bucket_rows)) for r in sums.collect()}


def shuffle_to_shards(
    df: DataFrame, key: str = "doc_id", size: str = "size", shards: int = 16, seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All columns of ``df`` with ``shard`` and ``slot``: each shard's records in random order, numbered from 0.

    ``size`` names a column with a record's bytes (null: 0). Null keys are one key; equal keys are in one shard but not
    in one bucket, and a shard that a frequent key makes large has the more buckets, so that no key makes a bucket large. Repeated rows stay. Columns of ``df`` named shard or slot are
    replaced. An empty table stays empty. The order follows from the seed and the stored scatter.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    drawn = shard_of(F.col(key), shards, seed)
    buckets = buckets_of(df.select(drawn.alias("shard"), F.col(size).alias("size")), bucket_bytes, bucket_rows)
    counts = F.array(*[F.lit(int(buckets.get(s, 1))).cast("long") for s in range(shards)])
    scattered = stored(
        df.select(F.struct(*columns).alias("record"), F.col(key).alias("k"), F.monotonically_increasing_id().alias("position"),
                  drawn.alias("shard"))
        .select("record", "position", "shard",
                F.pmod(F.xxhash64("k", "position", F.lit(seed)), F.get(counts, F.col("shard"))).alias("bucket")), "shard-scatter", compression="zstd")
    # Buckets are numbered through all shards, and a bucket's number is its task's, so no task holds two.
    firsts, total = [], 0
    for shard in range(shards):
        firsts.append(total)
        total += int(buckets.get(shard, 1))
    numbered = scattered.withColumn("id", (F.get(F.array(*[F.lit(n) for n in firsts]), F.col("shard")) + F.col("bucket")).cast("int"))
    before = Window.partitionBy("shard").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("shard", "id").agg(F.count("*").alias("n")).select(
        "shard", "id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    gathered = numbered.repartitionById(total, "id").groupBy("id").agg(F.collect_list(F.struct("position", "record")).alias("records"))
    # A row for each bucket; beyond that many it is an ordinary join.
    starts = F.broadcast(starts) if total <= BROADCAST_BUCKETS else starts
    ordered = gathered.join(starts, "id").select("shard", "first", F.expr(
        "array_sort(records, (x, y) -> CASE WHEN x.position < y.position THEN -1 WHEN x.position > y.position THEN 1 ELSE 0 END)"
    ).alias("records"))
    mixed = ordered.select("shard", "first", F.posexplode(F.shuffle("records", seed)).alias("at", "drawn"))
    return mixed.select("drawn.record.*", F.col("shard").cast("int").alias("shard"),
                        (F.col("first") + F.col("at")).cast("long").alias("slot"))


def record_bytes(df: DataFrame) -> Column:
    """Bytes of a row's texts and binaries and one more; what the buckets are sized by."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in wide), F.lit(1)).cast("long")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 16) -> None:
    """Write whole records with their slot into a folder for each shard, in slot order within each file.

    A task writes the bucket that it ordered, so texts are not dealt again; a file is as large as a bucket.
    """
    placed = shuffle_to_shards(df.withColumn(SIZE, record_bytes(df)), key, SIZE, shards).drop(SIZE)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of ``write_shards`` with shard and slot, from the files; ``schema`` is that of the records."""
    own = [f for f in schema.fields if f.name not in ("shard", "slot")]
    return spark.read.schema(T.StructType([*own, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each record in the shards that it writes.

    Whole records are written into the shared folder, and all of this is taken from the files read back. ``size`` is the
    text's UTF-8 bytes plus 1 (null text: 1, and the checksum of no bytes). The law is ``key``; ``grown_shard`` is where
    the record would go with one shard more.
    """
    path = shared_dir(df.sparkSession, "shards")
    write_shards(df, path, key, shards)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return read_shards(df.sparkSession, path, df.schema).select(
        F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", shard_of(F.col(key), shards + 1).cast("int").alias("grown_shard"))
