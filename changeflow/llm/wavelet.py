"""Token-id output as one wavelet matrix for each shard: a compressed file that answers access, count and lookup.

A shard is a run of whole documents in key order. Its ids become bit-planes, the highest bit first; after each plane the
ids are split stably into those with a 0 and those with a 1. With ranks of set bits sampled by block, a token is read by
following one bit of each plane, and a token's occurrences are counted and found the same way, without decoding.
"""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import prepared, stored, texts
from changeflow.llm.tokens import default_tokenizer, encoder
from changeflow.session import shared_dir

# Fixed values of the file format.
MAGIC = b"WMX1"
BLOCK = 4096
SUFFIX = ".wmx"
# A shard ends with the document that reaches this many ids.
SHARD_TOKENS = 1 << 22
# Ids that are split or merged at a time, so that their places stay in a core's cache.
STRIDE = 1 << 15


class WaveletMatrix:
    """Access, rank, count and select over a sequence of unsigned ids."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray], n: int):
        self.planes, self.zeros, self.ranks, self.n = planes, zeros, ranks, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        current = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        after = np.empty_like(current)
        planes, zeros, ranks = [], [], []
        for shift in range(depth - 1, -1, -1):
            bit = (current & current.dtype.type(1 << shift)) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            ranks.append(cls._sampled(packed))
            zeros.append(len(current) - int(np.count_nonzero(bit)))
            low, high = 0, zeros[-1]
            for start in range(0, len(current), STRIDE):
                here, there = current[start:start + STRIDE], bit[start:start + STRIDE]
                ones, others = np.flatnonzero(there), np.flatnonzero(~there)
                here.take(ones, out=after[high:high + len(ones)], mode="clip")
                here.take(others, out=after[low:low + len(others)], mode="clip")
                low, high = low + len(others), high + len(ones)
            current, after = after, current
        return cls(planes, zeros, ranks, len(ids))

    @staticmethod
    def _sampled(packed: np.ndarray) -> np.ndarray:
        """Set bits before each block."""
        counts = np.bitwise_count(packed).astype(np.uint32)
        sums = np.add.reduceat(counts, np.arange(0, len(packed), BLOCK // 8)) if len(packed) else np.zeros(0, np.uint32)
        return np.concatenate(([0], np.cumsum(sums))).astype(np.uint32)

    def _ones(self, level: int, at: int) -> int:
        """Set bits of a plane before place ``at``."""
        block, rest = divmod(at, BLOCK)
        first = block * (BLOCK // 8)
        whole, bits = divmod(rest, 8)
        plane = self.planes[level]
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:first + whole]).sum())
        return count + (int(plane[first + whole]) >> (8 - bits)).bit_count() if bits else count

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[at >> 3]) >> (7 - (at & 7)) & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences from ``start`` to ``end`` stand after the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _place_of(self, level: int, wanted: int, bit: int) -> int:
        """The place of the ``wanted``-th (from 0) bit of that value in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        seen = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(seen, wanted, side="right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[level][first:first + BLOCK // 8])[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[wanted - int(seen[block])])

    def select(self, token: int, which: int) -> int:
        """Place of the token's occurrence number ``which``, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= which < b - a:
            raise IndexError(which)
        at = a + which
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._place_of(level, at - self.zeros[level] if bit else at, bit)
        return at

    def all(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        current = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        before = np.empty_like(current)
        for shift, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            current[zeros:] |= current.dtype.type(1 << shift)
            low, high = 0, zeros
            for start in range(0, self.n, STRIDE):
                here, there = before[start:start + STRIDE], bit[start:start + STRIDE]
                ones, others = np.flatnonzero(there), np.flatnonzero(~there)
                here[ones] = current[high:high + len(ones)]
                here[others] = current[low:low + len(others)]
                low, high = low + len(others), high + len(ones)
            current, before = before, current
        return current


def write_shard(ids: np.ndarray, keys: pa.Array, lengths: list[int], head: dict) -> bytes:
    """A shard file: a JSON header with the sizes of what follows, keys, document lengths, and the planes with ranks."""
    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
    parts = [pack(sink.getvalue().to_pybytes()), pack(np.array(lengths, "<u4").tobytes())]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        parts += [pack(plane.tobytes()), pack(ranks.astype("<u4").tobytes())]
    header = json.dumps(head | {"n": matrix.n, "zeros": matrix.zeros, "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(parts)


def read_shard(data: bytes) -> tuple[WaveletMatrix, pa.Array, np.ndarray, dict]:
    """The matrix, document keys, document lengths and header of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = struct.unpack("<I", data[4:8])[0]
    head = json.loads(data[8:8 + size])
    at, parts = 8 + size, []
    unpack = zstandard.ZstdDecompressor().decompress
    for length in head["sizes"]:
        parts.append(unpack(data[at:at + length]))
        at += length
    keys = pa.ipc.open_stream(parts[0]).read_all().column("key").combine_chunks()
    planes = [np.frombuffer(p, np.uint8) for p in parts[2::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[3::2]]
    return WaveletMatrix(planes, head["zeros"], ranks, head["n"]), keys, np.frombuffer(parts[1], "<u4"), head


def _store(folder: str, name: str, data: bytes) -> None:
    """Write a file under its final name at once, so that a repeated task replaces it by the same content."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = posixpath.join(path, f"_{name}.{TaskContext.get().taskAttemptId()}")
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, posixpath.join(path, name))


MANIFEST = "part int, shard int, n_docs long, n_tokens long"


def write_token_files(
    df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode whole texts, end each with ``end_id``, and write shard files in ascending key order; returns the manifest.

    ``folder`` is reachable from all executors. Null keys come first, null and empty texts are their end id alone, and
    rows with the same key follow one another in an order that their texts decide. A task holds one shard at a time, which
    has whole documents. An empty table writes no file.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(path).many_raw
        made, written, shard = [], 0, 0
        keys, lengths, parts, n, kind = [], [], [], 0, None

        def flush():
            nonlocal written, shard, n
            head = {"part": part, "shard": shard, "first": written}
            data = write_shard(np.frombuffer(b"".join(parts), "<u4"), pa.array(keys, kind), lengths, head)
            _store(folder, f"part-{part:05d}-{shard:06d}{SUFFIX}", data)
            made.append((part, shard, len(keys), n))
            written, shard, n = written + n, shard + 1, 0
            keys.clear(), lengths.clear(), parts.clear()

        for batch in batches:
            kind = batch.column("k").type
            codes = encode([raw or b"" for raw in texts(batch, "t")])
            for name, code in zip(batch.column("k").to_pylist(), codes, strict=True):
                ids = code + end
                keys.append(name)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                n += len(ids) // 4
                if n >= shard_tokens:
                    flush()
        if n:
            flush()
        columns = list(zip(*made, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            names=["part", "shard", "n_docs", "n_tokens"])

    return stored(prepared(ordered).mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(folder: str, manifest: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, decoded from the shard files."""
    spark = manifest.sparkSession
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                matrix, keys, lengths, head = read_shard(data.as_py())
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array([head["part"]] * n, pa.int32()), pa.array(starts + head["first"]),
                    pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()),
                ], names=[key, "part", "at", "n", "crc"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    pieces = prepared(files).mapInArrow(run, schema)
    # One row for each partition of the writer; their number is that of its shuffle partitions.
    sums = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("at"))
    return placed.select(key, "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_table(
    df: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None
) -> DataFrame:
    """Write ``df`` as shard files into the shared folder and read (key, start, n_tokens, ids_crc32) back from them."""
    folder = shared_dir(df.sparkSession, "tokens")
    manifest = write_token_files(df, folder, key, text, end_id, tokenizer)
    kind = df.schema[key].dataType
    if manifest.limit(1).count() == 0:
        empty = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
        return df.sparkSession.createDataFrame([], empty)
    return read_token_files(folder, manifest, key, kind)
