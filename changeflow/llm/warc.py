"""WARC archives whose repeated payloads are revisit records.

Pages are written as response records, each a gzip member of its own. An index of the archives has one header row for
each record. Only these rows are shuffled, by payload digest: the record with the smallest key of each digest stays the
original, and all others are joined to it. Then each range of records is read again at its offsets and written into new
archives with fresh headers, as a response with its payload or as a revisit without it.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import prepared, stored, texts
from changeflow.session import shared_dir

# Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 15
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

FILES = "file string, records long"
INDEX = ("file string, offset long, length long, record_id string, date string, uri string, page_key string, "
         "digest string, strong string, payload_bytes long")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(payload_bytes: int, payload: bytes = b"") -> bytes:
    """A response's HTTP part; a revisit has its headers, which tell the full length, and no payload."""
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
            ).encode() + payload


def one_line(value: str) -> str:
    """Control characters percent-encoded, so that a value can't end its header."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member; headers without a value are left out."""
    block_digest = ("WARC-Block-Digest", f"sha1:{payload_digest(block)}")
    lines = [VERSION] + [f"{k}: {v}" for k, v in [*headers, block_digest, ("Content-Length", str(len(block)))] if v is not None]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an unpacked record, whose length and block digest must fit."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4:end + 4 + int(headers["Content-Length"])]
    if headers.get("WARC-Block-Digest", "sha1:" + payload_digest(block)) != "sha1:" + payload_digest(block):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The payload length that the HTTP headers state, and the payload that is there."""
    end = block.index(b"\r\n\r\n")
    stated = next(line for line in block[:end].split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return int(stated.split(b":")[1]), block[end + 4:]


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, unpacked bytes) of each gzip member of a file."""
    held, offset = b"", 0
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not held:
                held = stream.read(READ_BYTES)
                if not held:
                    if used:
                        raise ValueError("archive ends inside a record")
                    return
            parts.append(unpack.decompress(held))
            used += len(held)
            held = unpack.unused_data
        used -= len(held)
        yield offset, used, b"".join(parts)
        offset += used


class _Archives:
    """The archives that one task writes, each begun with a record about itself.

    Names carry the attempt, so a repeated task never writes into a file of another; the table of files, which Spark
    commits, tells which ones count.
    """

    def __init__(self, folder: str, run: str, date: str):
        from pyarrow import fs

        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        context = TaskContext.get()
        self.folder, self.path, self.run, self.date = folder, path, run, date
        self.part, self.attempt = context.partitionId(), context.taskAttemptId()
        self.files: list[tuple[str, int]] = []
        self.out, self.size, self.records, self.made = None, 0, 0, 0

    def record_id(self) -> str:
        self.made += 1
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{self.run}/{self.part}/{self.made}')}>"

    def add(self, headers: list[tuple[str, str | None]], block: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.attempt}-{len(self.files):05d}.warc.gz"
            self.out = self.system.open_output_stream(posixpath.join(self.path, self.name), compression=None)
            self._write(record([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", self.record_id()), ("WARC-Date", self.date),
                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(record(headers, block))
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((f"{self.folder.rstrip('/')}/{self.name}", self.records))
            self.out, self.size, self.records = None, 0, 0

    def table(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in self.files], pa.string()), pa.array([f[1] for f in self.files], pa.int64())],
            names=["file", "records"])


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a response record for each row below ``folder``, which all executors reach; returns (file, records)."""
    run_id, date = uuid.uuid4().hex, _now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = None
        for batch in batches:
            keys, urls = batch.column("k").to_pylist(), batch.column("u").to_pylist()
            for name, uri, raw in zip(keys, urls, texts(batch, "p"), strict=True):
                archives = archives or _Archives(folder, run_id, date)
                raw = raw or b""
                archives.add([
                    ("WARC-Type", "response"), ("WARC-Record-ID", archives.record_id()), ("WARC-Date", date),
                    ("WARC-Target-URI", None if uri is None else one_line(uri)), ("Content-Type", HTTP_TYPE),
                    ("WARC-Payload-Digest", "sha1:" + payload_digest(raw)),
                    ("Page-Key", None if name is None else json.dumps(name))], http_block(len(raw), raw))
        if archives:
            yield archives.table()

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(url).cast("string").alias("u"), F.col(payload).alias("p"))
    return stored(prepared(rows).mapInArrow(run, FILES), "warc-files")


def _each_file(files: DataFrame) -> DataFrame:
    """One task for each file, or nearly so."""
    count = max(1, files.count())
    return prepared(files.select("file").repartitionByRange(count, "file"))


def _open(name: str, random: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name)
    return system.open_input_file(path) if random else system.open_input_stream(path, compression=None)


def index_archives(files: DataFrame) -> DataFrame:
    """A header row for each response record of the archives, with a second, stronger digest of its payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with _open(name) as stream:
                    for offset, length, data in members(stream):
                        headers, block = parse(data)
                        if headers["WARC-Type"] != "response":
                            continue
                        stated, payload = payload_of(block)
                        digest = payload_digest(payload)
                        if stated != len(payload) or headers.get("WARC-Payload-Digest", "sha1:" + digest) != "sha1:" + digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't fit its headers")
                        key = headers.get("Page-Key")
                        rows.append((name, offset, length, headers["WARC-Record-ID"], headers["WARC-Date"],
                                     headers.get("WARC-Target-URI"), None if key is None else json.loads(key), digest,
                                     hashlib.sha256(payload).hexdigest(), len(payload)))
                        if len(rows) == 10_000:
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    return stored(_each_file(files).mapInArrow(run, INDEX), "warc-index")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    numbers = {"offset", "length", "payload_bytes"}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if n in numbers else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)],
        names=names)


def resolve_revisits(index: DataFrame, kind: T.DataType, min_bytes: int = 0) -> DataFrame:
    """The index with original_id, original_key, original_uri and original_date, which are null where a record stays a response.

    Of records with equal payloads of at least ``min_bytes`` the one with the smallest key, of type ``kind``, is the
    original; null keys come after all others, and records with the same key in the order of the archives. Only
    payloads that occur more than once are joined back.
    """
    same = ["digest", "strong", "payload_bytes"]
    key = F.col("page_key").try_cast(kind)
    order = F.struct(key.isNull().alias("none"), key.alias("key"), F.col("file").alias("original_file"),
                     F.col("offset").alias("original_offset"), F.col("record_id").alias("original_id"),
                     F.col("uri").alias("original_uri"), F.col("date").alias("original_date"))
    groups = index.filter(F.col("payload_bytes") >= min_bytes).groupBy(*same).agg(F.min(order).alias("o"), F.count("*").alias("n"))
    originals = groups.filter("n > 1").select(*same, F.col("o.key").cast("string").alias("original_key"),
                                              "o.original_id", "o.original_uri", "o.original_date")
    revisit = F.col("original_id").isNotNull() & (F.col("original_id") != F.col("record_id"))
    parts = ["original_id", "original_key", "original_uri", "original_date"]
    return index.join(originals, same, "left").withColumn("is_revisit", revisit).select(
        *index.columns, "is_revisit", *[F.when(F.col("is_revisit"), F.col(c)).alias(c) for c in parts])


def write_resolved(resolved: DataFrame, folder: str, count: int) -> DataFrame:
    """Write all records into new archives below ``folder``, in about ``count`` tasks; returns (file, records)."""
    run_id, date = uuid.uuid4().hex, _now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, source, stream = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                archives = archives or _Archives(folder, run_id, date)
                headers = [
                    ("WARC-Type", "revisit" if row["is_revisit"] else "response"), ("WARC-Record-ID", row["new_id"]),
                    ("WARC-Date", row["date"]), ("WARC-Target-URI", row["uri"]), ("Content-Type", HTTP_TYPE),
                    ("WARC-Payload-Digest", "sha1:" + row["digest"]),
                    ("Page-Key", None if row["page_key"] is None else json.dumps(row["page_key"]))]
                if row["is_revisit"]:
                    key = row["original_key"]
                    archives.add(headers + [
                        ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["original_new_id"]),
                        ("WARC-Refers-To-Target-URI", row["original_uri"]), ("WARC-Refers-To-Date", row["original_date"]),
                        ("Refers-To-Page-Key", None if key is None else json.dumps(key))], http_block(row["payload_bytes"]))
                    continue
                if row["file"] != source:
                    if stream is not None:
                        stream.close()
                    source, stream = row["file"], _open(row["file"], random=True)
                data = zlib.decompress(stream.read_at(row["length"], row["offset"]), 31)
                payload = payload_of(parse(data)[1])[1]
                archives.add(headers, http_block(len(payload), payload))
        if archives:
            yield archives.table()

    # A new id follows from the old one, so a revisit can name its original's without another join.
    fresh = {c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(F.sha2(F.concat(F.lit(run_id), F.col(old)), 256), 1, 32),
                         "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-8$3-a$4-$5"), F.lit(">"))
             for c, old in (("new_id", "record_id"), ("original_new_id", "original_id"))}
    rows = resolved.withColumns(fresh).drop("strong")
    ranges = rows.repartitionByRange(max(1, count), "file", "offset").sortWithinPartitions("file", "offset")
    return stored(prepared(ranges).mapInArrow(run, FILES), "warc-resolved-files")


def read_archives(files: DataFrame, key: str, kind: T.DataType, with_payload: bool = False) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, ...) of each response and revisit of the archives.

    Length and digest of a response are those of the payload that is there, and must fit its headers.
    """
    names = ["page_key", "payload_bytes", "payload_digest", "record_type", "refers_to_key", "target_uri", "record_id", "refers_to_id", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with _open(name) as stream:
                    for _, _, data in members(stream):
                        headers, block = parse(data)
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        stated, payload = payload_of(block)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(payload), payload_digest(payload)) != (stated, digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't fit its headers")
                        keys = [None if (k := headers.get(h)) is None else json.loads(k) for h in ("Page-Key", "Refers-To-Page-Key")]
                        whole = payload if with_payload and headers["WARC-Type"] == "response" else None
                        rows.append((keys[0], stated, digest, headers["WARC-Type"], keys[1], headers.get("WARC-Target-URI"),
                                     headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), whole))
                        size += len(whole or b"")
                        if len(rows) == 10_000 or size > 8 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows):
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    schema = ", ".join(f"{n} {dict(payload_bytes='long', payload='binary').get(n, 'string')}" for n in names)
    found = _each_file(files).mapInArrow(run, schema)
    rest = ["target_uri", "record_id", "refers_to_id"] + (["payload"] if with_payload else [])
    return found.select(F.col("page_key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to_key").cast(kind).alias("refers_to"), *rest)


def deduplicate_archives(files: DataFrame, kind: T.DataType, folder: str, min_bytes: int = 0) -> DataFrame:
    """New archives below ``folder`` in which repeated payloads of ``files`` are revisits; returns (file, records)."""
    return write_resolved(resolve_revisits(index_archives(files), kind, min_bytes), folder, files.count())


def archive_pages(
    df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    with_payload: bool = False,
) -> DataFrame:
    """Write pages as archives, replace repeated payloads by revisits, and read the new archives back.

    Returns (key, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id, refers_to_id), a row for
    each of ``df``. A null payload is empty, a null url has no target header, and control characters in a url are
    percent-encoded. Equal rows are records of their own: one is the response, the rest revisit it. A null key stays null
    and comes after all others. Keys need a type that casts to a string and back; other columns are left out. An empty
    table writes no archive and gives no rows.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    files = write_archives(df, shared_dir(spark, "warc"), key, url, payload)
    return read_archives(deduplicate_archives(files, kind, shared_dir(spark, "warc-resolved"), min_bytes), key, kind, with_payload)
