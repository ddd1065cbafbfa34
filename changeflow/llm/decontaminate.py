"""Benchmark decontamination: a prefix-filtered set join of document shingles with windows of benchmark items.

A window is contained only if all its shingles are, so one of them, the rarest over all documents, is the necessary
prefix. One pass over the documents counts the benchmark's shingles, which orders them by rarity. A second one finds the
places of prefixes; these are joined with the windows by Spark, as an equality join of any size. A window's place follows
from the prefix's position in it, bounds discard places that leave the document, and the words there are compared.

Tasks know shingles by 64-bit hashes and the sets of them by bitmaps of fixed size, so what is broadcast doesn't grow with
the benchmark. Both can only let more places into the join, where words decide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.collocations import Words, bitmap_of, has, mixed
from changeflow.llm.common import WORD_BYTES, append_columns, field, letter_words, prepared, stored, texts

WINDOW = 10
SHINGLE = 3
# Bytes of text that are taken at once.
SECTION = 2 << 20
# Hits are broadcast to the documents up to this size; beyond it the documents are shuffled once.
BROADCAST_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, keys) of all shingles of ``size`` words that lie in one text."""
    n = max(0, len(words.starts) - size + 1)
    key, fits = mixed(words.hashes[:n] ^ np.uint64(size)), np.ones(n, bool)
    for j in range(1, size):
        key = mixed(key * _BASE + words.hashes[j:j + n])
        fits &= words.joined[j - 1:j - 1 + n]
    firsts = np.flatnonzero(fits)
    return firsts, key[firsts]


class Part:
    """Some texts, or a section of a long one with ``margin`` words around it.

    ``text`` numbers each word's text, ``place`` its place there, and ``own`` says whether it is inside.
    """

    def __init__(self, words: Words, own: np.ndarray, place: np.ndarray):
        self.words, self.own, self.place, self.text = words, own, place, words.language


def parts(given: list[bytes | None], margin: int) -> Iterator[Part]:
    """The words of all texts, about ``SECTION`` bytes at a time."""
    held, size = [], 0
    for number, raw in enumerate(given):
        text = (raw or b"").translate(WORD_BYTES)
        if len(text) > SECTION:
            yield from _sections(text, number, margin)
            continue
        held.append((text, len(text), number))
        size += len(text)
        if size >= SECTION:
            yield _whole(held)
            held, size = [], 0
    if held:
        yield _whole(held)


def _whole(held: list[tuple[bytes, int, int]]) -> Part:
    words = Words(held)
    counts = np.bincount(words.language, minlength=held[-1][2] + 1)
    before = np.concatenate([[0], np.cumsum(counts)])[words.language]
    return Part(words, np.ones(len(words.starts), bool), np.arange(len(words.starts)) - before)


def _sections(text: bytes, number: int, margin: int) -> Iterator[Part]:
    ahead = re.compile(rb"(?: *[^ ]+){0,%d}" % margin)
    at, head, first = 0, 0, 0
    while at < len(text):
        gap = text.find(b" ", at + SECTION)
        end = len(text) if gap < 0 else gap
        data = text[head:ahead.match(text, end).end()]
        words = Words([(data, len(data), number)])
        own = (words.starts >= at - head) & (words.starts < end - head)
        place = np.arange(len(words.starts)) + first
        yield Part(words, own, place)
        # The next section begins with the last words of this one.
        inside = int(np.searchsorted(words.starts, end - head))
        back = max(0, inside - margin)
        if inside:
            first, head = first + back, head + int(words.starts[back])
        at = end


def _count(docs: DataFrame, text: str, sizes: list[int], known) -> DataFrame:
    """(key, n): occurrences of the benchmark's shingles in all documents; each task adds up first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in parts(texts(batch, text), max(sizes)):
                for size in sizes:
                    firsts, keys = shingles(part.words, size)
                    keys = keys[part.own[firsts]]
                    found.append(keys[has(known.value, keys)])
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return prepared(docs.select(text)).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, text: str, sizes: list[int], margin: int, prefixes) -> DataFrame:
    """(digest, place, key, before, context): where a prefix stands, with up to ``margin`` words on both sides of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            rows = []
            for part in parts(texts(batch, text), margin + max(sizes)):
                words = part.words
                last = len(words.starts) - 1
                for size in sizes:
                    firsts, keys = shingles(words, size)
                    chosen = part.own[firsts] & has(prefixes.value, keys)
                    for i, key in zip(firsts[chosen].tolist(), keys[chosen].view(np.int64).tolist(), strict=True):
                        number = part.text[i]
                        low, high = max(0, i - margin), min(last, i + margin)
                        while part.text[low] != number:
                            low += 1
                        while part.text[high] != number:
                            high -= 1
                        context = words.data[words.starts[low]:words.ends[high]]
                        rows.append((digests[number], int(part.place[i]), key, i - low, b" ".join(context.split())))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[:-1] + [columns[-1].cast(pa.string())],
                                                 names=["digest", "place", "key", "before", "context"])

    found = prepared(docs.select("digest", text)).mapInArrow(run, "digest binary, place long, key long, before int, context string")
    # Copies of a text have the same places.
    return found.dropDuplicates(["digest", "place", "key"])


def windows_of(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(window, size, items): the distinct windows of all items, words joined by spaces, with the items that have them."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("item").to_pylist(), texts(batch, "text"), strict=True):
                words = letter_words(raw) if raw else []
                for at in range(0, max(1, len(words) - window + 1) if words else 0, 10_000):
                    some = [words[i:i + window] for i in range(at, min(at + 10_000, max(1, len(words) - window + 1)))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b" ".join(w) for w in some], pa.binary()).cast(pa.string()),
                        pa.array([len(w) for w in some], pa.int32()), pa.array([name] * len(some), pa.string())],
                        names=["window", "size", "item"])

    found = prepared(rows).mapInArrow(run, "window string, size int, item string").distinct()
    return found.groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingled(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, offset, key): all shingles of all windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = texts(batch, "window")
            for part in parts(given, 0):
                for size in range(1, shingle + 1):
                    firsts, keys = shingles(part.words, size)
                    # A window shorter than a shingle has one of all its words.
                    if size < shingle:
                        lengths = np.bincount(part.text, minlength=len(given))
                        whole = lengths[part.text[firsts]] == size
                        firsts, keys = firsts[whole], keys[whole]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("window").take(pa.array(part.text[firsts])), pa.array(part.place[firsts].astype(np.int32)),
                         pa.array(keys.view(np.int64))], names=["window", "offset", "key"])

    return prepared(windows.select("window")).mapInArrow(run, "window string, offset int, key long")


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, shingle: int) -> DataFrame | None:
    """(digest, spans, found) of each different text with a window in it; ``spans`` are (place, size)."""
    context = docs.sparkSession.sparkContext
    windows = stored(windows_of(benchmark, item, item_text, window), "benchmark-windows")
    sizes = [r["size"] for r in windows.select(F.least("size", F.lit(shingle)).alias("size")).distinct().collect()]
    if not sizes:
        return None
    grams = stored(_shingled(windows, shingle), "benchmark-shingles")
    known = context.broadcast(bitmap_of(grams.select("key")))
    counts = stored(_count(docs, text, sorted(sizes), known), "benchmark-rarity")
    rarest = grams.join(counts, "key", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("rarest"))
    # A window whose rarest shingle is nowhere can't be anywhere.
    prefixes = stored(rarest.filter("rarest.n > 0").select("window", "rarest.key", "rarest.offset").join(windows, "window"),
                      "benchmark-prefixes")
    wanted = context.broadcast(bitmap_of(prefixes.select("key")))
    places = _places(docs, text, sorted(sizes), window - 1, wanted)
    start = F.col("before") - F.col("offset")
    there = F.array_join(F.slice(F.split("context", " "), F.greatest(start, F.lit(0)) + 1, F.col("size")), " ")
    met = places.join(prefixes, "key").filter((start >= 0) & (there == F.col("window")))
    spans = met.select("digest", F.struct((F.col("place") - F.col("offset")).alias("at"), "size").alias("span"), "items")
    return stored(spans.groupBy("digest").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found")),
        "benchmark-hits")


FIELDS = [
    field("n_words", "long"), field("n_hit", "long"), field("n_items", "long"), field("items_sha256", "string"),
    field("contaminated", "boolean"), field("items", "array string"), field("hit_words", "array int"),
]
OWN = ["__digest", "__spans", "__found"]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """All columns of ``docs``, with the words that lie in windows of benchmark items and the items' ids.

    A window is ``window`` consecutive words of an item; a shorter item is one window, one without words none. A null or
    empty text has no words and is clean; an item without an id counts under the empty id; repeated items count once and
    repeated documents one by one. Columns of ``docs`` with a result's name are replaced. An empty benchmark leaves all
    documents clean. The documents are read three times, whatever the size of the benchmark: for rarity, for places, and
    for the result, to which hits are joined by the text's SHA-256; they are broadcast up to ``BROADCAST_BYTES``.
    """
    digest = F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    hits = _hits(docs.select(F.col(text), digest.alias("digest")), benchmark, text, item, item_text, window, shingle)
    names = {f.name for f in FIELDS} - {text}
    kept = docs.drop(*names).withColumn("__digest", digest)
    if hits is None:
        empty = "array<struct<at:bigint,size:int>>"
        joined = kept.withColumns({"__spans": F.lit(None).cast(empty), "__found": F.lit(None).cast("array<string>")})
    else:
        size = F.octet_length("digest") + 24 * F.size("spans") + F.aggregate("found", F.lit(0), lambda n, name: n + F.octet_length(name) + 24)
        total = hits.agg(F.sum(size)).first()[0] or 0
        found = hits.toDF(*OWN)
        joined = kept.join(F.broadcast(found) if total <= BROADCAST_BYTES else found, "__digest", "left")
    return append_columns(joined, FIELDS, _results(text), drop=OWN)


def _results(text: str):
    def make(batch: pa.RecordBatch) -> list[list]:
        out: list[list] = [[] for _ in FIELDS]
        columns = [texts(batch, text), batch.column("__spans").to_pylist(), batch.column("__found").to_pylist()]
        for raw, spans, found in zip(*columns, strict=True):
            space = np.frombuffer((raw or b"").translate(WORD_BYTES), np.uint8) == 32
            n_words = int(np.count_nonzero(~space & np.concatenate([[True], space[:-1]]))) if len(space) else 0
            place = sorted({i for s in spans or () for i in range(s["at"], s["at"] + s["size"])})
            digest = hashlib.sha256(",".join(found or ()).encode()).hexdigest()
            row = (n_words, len(place), len(found or ()), digest, bool(place), found or [], place)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    return make
