"""Phrase collocation mining by partitioning into shards: what is frequent somewhere is counted everywhere.

A phrase that occurs ``support`` times in a language occurs at least ``support * w / W`` times in one shard, where ``w`` and
``W`` are the shard's and the language's words. So each shard is mined completely at that lowered support, and the union
of what shards find holds every frequent phrase. Shards are a fixed number of groups of tasks, so that the local support
stays well over one at any size; their counts are added up by a shuffle of what each task has added up before, and stand
side by side, so that a phrase of the union is counted everywhere without another pass over the texts.

Words that occur ``support`` times have numbers, told apart by their bytes. Phrases are known by the numbers of their words,
so that all counts are exact; a phrase with a rarer word is not frequent. Longer phrases are mined where all their word pairs
are in a bitmap of the frequent ones, which has a fixed size and only lets more phrases through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import prepared, stored, texts

SHARDS = 8
# A bitmap has 2^28 bits, 32 MB; it is made in segments of 2^22.
BITMAP, SEGMENT = 28, 22
# Bytes of text that are taken at once, and keys or strings that a task adds up before it passes them on.
SECTION = 2 << 20
HELD_KEYS, HELD_STRINGS = 3 << 20, 1 << 19
# Rows of a batch that a task passes on.
BATCH = 1 << 15

# Every separator of pieces becomes a line break, a tab becomes a space, A-Z become a-z.
PIECES = bytes(
    10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP, _AHEAD = re.compile(rb"[ \n]"), re.compile(rb"(?:[ \n]*[^ \n]+){0,3}")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def sections(text: bytes, size: int = SECTION) -> Iterator[tuple[bytes, int]]:
    """Cut a translated text between words; each part has the three words after it, and the length that is its own."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        end = gap.start()
        yield text[at:_AHEAD.match(text, end).end()], end - at
        at = end
    yield text[at:], len(text) - at


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_FACTOR = 0xD6E8FEB86659FD93


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_FACTOR)
    return h ^ (h >> np.uint64(29))


def unmixed(h: np.ndarray) -> np.ndarray:
    """What ``mixed`` made these of; it maps no two values to one."""
    h = (h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))) * np.uint64(pow(_FACTOR, -1, 1 << 64))
    return h ^ (h >> np.uint64(32))


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))


class Words:
    """Words of some sections: where they start and end, their hashes, and how many follow in the same piece."""

    def __init__(self, parts: list[tuple[bytes, int, int]]):
        """``parts`` has (section, own length, language)."""
        self.data = b"\n".join(p[0] for p in parts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        inside = (raw != 32) & (raw != 10)
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        firsts = np.cumsum([0] + [len(p[0]) + 1 for p in parts[:-1]])
        part = np.searchsorted(firsts, self.starts, "right") - 1
        self.own = self.starts < (firsts + np.array([p[1] for p in parts]))[part]
        self.language = np.array([p[2] for p in parts], np.int64)[part]
        piece = np.cumsum(raw == 10)[self.starts]
        # A word and the one after it lie in one piece.
        self.joined = piece[1:] == piece[:-1]
        sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums])
        self.hashes = mixed((before[self.ends] - before[self.starts]) * _powers(_INVERSE, len(raw))[self.starts])

    def phrases(self, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, keys) of the phrases of two to four words that start in own text.

        With ``allowed``, a bitmap of pairs, phrases whose pairs aren't all in it are left out.
        """
        seeds = mixed(self.language.astype(np.uint64) + np.uint64(7))
        key, fits = mixed(self.hashes ^ seeds), np.ones(len(self.starts), bool)
        pair = None
        for length in (2, 3, 4):
            n = max(0, len(self.starts) - length + 1)
            key = mixed(key[:n] * np.uint64(_BASE) + self.hashes[length - 1:length - 1 + n])
            fits = fits[:n] & self.joined[length - 2:length - 2 + n]
            if length == 2:
                pair = has(allowed, key) if allowed is not None else None
            if pair is not None:
                fits = fits & pair[length - 2:length - 2 + n]
            firsts = np.flatnonzero(fits & self.own[:n])
            yield length, firsts, key[firsts]

    def numbered(
        self, vocabulary: Vocabulary, allowed: np.ndarray | None = None,
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, first words, key, rest) of the phrases of two to four known words that start in own text.

        ``key`` is of the numbers of the first two words and ``rest`` has those of the others, so both tell phrases apart.
        """
        ids = vocabulary.find(self)
        n = max(0, len(ids) - 1)
        fits = self.joined[:n] & (ids[:n] > 0) & (ids[1:] > 0)
        key = mixed(ids[:n] << np.uint64(32) | ids[1:])
        if allowed is not None:
            fits[fits] = has(allowed, key[fits])
        pair, after = fits, np.concatenate([ids[2:] << np.uint64(32), np.zeros(2, np.uint64)])
        for length in (2, 3, 4):
            if length > 2:
                n = max(0, len(ids) - length + 1)
                fits = fits[:n] & pair[length - 2:length - 2 + n]
            firsts = np.flatnonzero(fits & self.own[:n])
            rest = after[firsts] if length > 2 else np.zeros(len(firsts), np.uint64)
            yield length, firsts, key[firsts], rest | ids[firsts + 3] if length > 3 else rest

    def strings(self, firsts: np.ndarray, length: int) -> list[bytes]:
        """The phrases as text, with one space between words."""
        a, b = self.starts[firsts], self.ends[firsts + length - 1]
        size = sum(self.ends[firsts + i] - self.starts[firsts + i] for i in range(length)) + length - 1
        data = self.data
        return [data[i:j] if plain else b" ".join(data[i:j].split())
                for i, j, plain in zip(a.tolist(), b.tolist(), (b - a == size).tolist(), strict=True)]


class Vocabulary:
    """Words of languages, numbered from 1 and found by hash, then by their bytes."""

    def __init__(self, languages: np.ndarray, words: list[bytes]):
        """A word and its language stand at the place of its number; no two are equal."""
        self.data = b"".join(words)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.languages = np.asarray(languages, np.int64)
        keys = np.zeros(len(words), np.uint64)
        ends, at = self.starts + self.lengths, 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, self.starts[at] + SECTION)))
            some = b" ".join(words[at:to])
            keys[at:to] = self.keys(Words([(some, len(some), 0)]).hashes, self.languages[at:to])
            at = to
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        # Words of one hash stand side by side.
        same = np.flatnonzero(np.concatenate([[True], self.sorted[1:] != self.sorted[:-1]])) if len(words) else np.zeros(0, int)
        self.most = int(np.diff(same, append=len(words)).max(initial=0))

    @staticmethod
    def keys(hashes: np.ndarray, languages: np.ndarray) -> np.ndarray:
        return mixed(hashes ^ mixed(languages.astype(np.uint64) + np.uint64(7)))

    def find(self, words: Words) -> np.ndarray:
        """The number of each word, 0 for those that are not known."""
        ids = np.zeros(len(words.starts), np.uint64)
        if not len(self.sorted):
            return ids
        keys = self.keys(words.hashes, words.language)
        at = np.searchsorted(self.sorted, keys)
        lengths = words.ends - words.starts
        mine, theirs = _eights(words.data), _eights(self.data)
        for step in range(self.most):
            place = np.minimum(at + step, len(self.sorted) - 1)
            some = np.flatnonzero((ids == 0) & (at + step < len(self.sorted)) & (self.sorted[place] == keys))
            number = self.order[place[some]]
            alike = (self.lengths[number] == lengths[some]) & (self.languages[number] == words.language[some])
            some, number = some[alike], number[alike]
            equal = self._equal(words, mine, theirs, some, number)
            ids[some[equal]] = (number[equal] + 1).astype(np.uint64)
        return ids

    def _equal(self, words: Words, mine: np.ndarray, theirs: np.ndarray, some: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether words have the bytes of known ones of their length: eight by eight, and what is over 64 bytes at once."""
        equal, left = np.ones(len(some), bool), np.arange(len(some))
        for at in range(0, 64, 8):
            here = words.starts[some[left]] + at
            rest = np.minimum(self.lengths[number[left]] - at, 8)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * rest).astype(np.uint64)
            good = (mine[here] ^ theirs[self.starts[number[left]] + at]) & mask == 0
            equal[left[~good]] = False
            left = left[good & (self.lengths[number[left]] > at + 8)]
        for i in left.tolist():
            a, b, n = int(words.starts[some[i]]), int(self.starts[number[i]]), int(self.lengths[number[i]])
            equal[i] = words.data[a + 64:a + n] == self.data[b + 64:b + n]
        return equal

    def strings(self) -> pa.Array:
        """All words, at the places of their numbers."""
        offsets = np.append(self.starts, len(self.data)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(self.data))


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - BITMAP)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, int, int]]]:
    """Sections of translated texts, about ``SECTION`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        for raw, language in zip(texts(batch, "text"), batch.column("lang_id").to_pylist(), strict=True):
            for part, own in sections((raw or b"").translate(PIECES)):
                held.append((part, own, language))
                size += len(part)
                if size >= SECTION:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of single words, from (lang, text); each task adds up before the shuffle.

    Languages without words have one row with a null word and 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def rows():
            for name, words in found.items():
                for some in batched(words.items() or [(None, 0)], BATCH):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some), pa.string()), pa.array([w for w, _ in some], pa.binary()).cast(pa.string()),
                         pa.array([n for _, n in some], pa.int64())], names=["lang", "phrase", "n"])
            found.clear()

        for batch in batches:
            for raw, name in zip(texts(batch, "text"), batch.column("lang").to_pylist(), strict=True):
                mine = found.setdefault(name, Counter())
                for part, own in sections((raw or b"").translate(PIECES)):
                    mine.update(part[:own].split())
                    if len(mine) >= HELD_STRINGS:
                        yield from rows()
                        mine = found.setdefault(name, Counter())
            if sum(map(len, found.values())) + len(found) >= HELD_STRINGS:
                yield from rows()
        yield from rows()

    counts = prepared(docs.select("lang", "text")).mapInArrow(run, "lang string, phrase string, n long")
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _added(keys: list[np.ndarray], rests: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, rest, weights = np.concatenate(keys), np.concatenate(rests), np.concatenate(counts)
    if not len(key):
        return key, rest, weights
    # What falls between equal rows here is added up by Spark.
    order = np.argsort(mixed(key + rest * np.uint64(_BASE)))
    key, rest, weights = key[order], rest[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])]))
    return key[first], rest[first], np.add.reduceat(weights, first)


def mine_shards(docs: DataFrame, languages: DataFrame, support: int, lengths: tuple[int, ...], pairs=None,
                shards: int = SHARDS, vocabulary=None) -> DataFrame:
    """(lang_id, key, rest, f): phrases that are frequent in some shard at its share of ``support``, and so over all shards.

    ``docs`` has (lang_id, text), ``languages`` (lang_id, n). A task's documents belong to the shard of its number. With a
    broadcast ``vocabulary`` phrases are numbers of its words and ``f`` is exact; without one ``key`` is a hash, ``rest`` is 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        allowed = None if pairs is None else pairs.value
        held: dict[int, list] = {}
        words: Counter = Counter()

        def rows(language, keys, rests, counts):
            n = len(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, language, np.int64)), pa.array(np.full(n, shard, np.int32)), pa.array(keys.view(np.int64)),
                 pa.array(rests.view(np.int64)), pa.array(counts)], names=["lang_id", "shard", "key", "rest", "n"])

        def passed_on(language):
            added = _added(*zip(*held.pop(language), strict=True))
            for at in range(0, len(added[0]), BATCH):
                yield rows(language, *(x[at:at + BATCH] for x in added))

        for chunk in _chunks(batches):
            found = Words(chunk)
            if vocabulary is None:
                phrases = ((length, firsts, some, np.zeros_like(some)) for length, firsts, some in found.phrases(allowed))
            else:
                phrases = found.numbered(vocabulary.value, allowed)
            keys, rests, langs = [], [], []
            for length, firsts, some, rest in phrases:
                if length in lengths:
                    keys.append(some)
                    rests.append(rest)
                    langs.append(found.language[firsts])
            keys, rests, langs = np.concatenate(keys), np.concatenate(rests), np.concatenate(langs)
            for language in np.unique(found.language[found.own]).tolist():
                words[language] += int(np.count_nonzero(found.own & (found.language == language)))
                mine = langs == language
                parts = held.setdefault(language, [])
                parts.append(_added([keys[mine]], [rests[mine]], [np.ones(np.count_nonzero(mine), np.int64)]))
                if sum(len(p[0]) for p in parts) >= HELD_KEYS:
                    parts[:] = [_added(*zip(*parts, strict=True))]
                    if len(parts[0][0]) >= HELD_KEYS // 2:
                        yield from passed_on(language)
            while held and sum(len(p[0]) for parts in held.values() for p in parts) >= 2 * HELD_KEYS:
                yield from passed_on(max(held, key=lambda g: sum(len(p[0]) for p in held[g])))
        for language in list(held):
            yield from passed_on(language)
        for language, n in words.items():
            # The words of the shard come in the same table, under no key.
            yield pa.RecordBatch.from_arrays(
                [pa.array([language], pa.int64()), pa.array([shard], pa.int32()), pa.array([None], pa.int64()),
                 pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["lang_id", "shard", "key", "rest", "n"])

    counts = prepared(docs.select("lang_id", "text")).mapInArrow(run, "lang_id long, shard int, key long, rest long, n long")
    # Counts of a phrase in all shards stand in one row.
    summed = stored(counts.repartition("lang_id", "key", "rest").groupBy("lang_id", "key", "rest").agg(
        *[F.sum(F.when(F.col("shard") == i, F.col("n"))).alias(f"n{i}") for i in range(shards)]), "phrase-shards")
    needs = stored(summed.filter("key IS NULL").join(languages, "lang_id").select("lang_id", *[
        F.expr(f"cast((cast(n{i} AS decimal(19,0)) * {support} + n - 1) div n AS bigint)").alias(f"need{i}")
        for i in range(shards)]), "phrase-needs")
    somewhere = " OR ".join(f"n{i} >= need{i}" for i in range(shards))
    everywhere = " + ".join(f"coalesce(n{i}, 0)" for i in range(shards))
    union = summed.filter("key IS NOT NULL").join(needs, "lang_id").filter(somewhere)
    return union.select("lang_id", "key", "rest", F.expr(everywhere).alias("f")).filter(F.col("f") >= support)


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of hashes, 2^BITMAP bits whatever the number of keys; tasks make its segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bits = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                names=["segment", "bits"])

        for batch in batches:
            segments = batch.column("segment").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            at = (keys >> np.uint64(64 - BITMAP) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)
            for segment in np.unique(segments).tolist():
                if segment != current:
                    if current is not None:
                        yield row()
                    current, bits = segment, np.zeros(1 << SEGMENT, bool)
                bits[at[segments == segment]] = True
        if current is not None:
            yield row()

    count = 1 << (BITMAP - SEGMENT)
    segment = F.shiftrightunsigned("key", 64 - BITMAP + SEGMENT).cast("long").alias("segment")
    sorted_keys = keys.select("key", segment).repartition(count, "segment").sortWithinPartitions("segment")
    whole, size = np.zeros(1 << (BITMAP - 3), np.uint8), 1 << (SEGMENT - 3)
    for row in prepared(sorted_keys).mapInArrow(run, "segment long, bits binary").collect():
        whole[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return whole


def vocabulary_of(words: DataFrame) -> Vocabulary:
    """The words of (lang_id, phrase); they pass through the driver, and every task holds them with 40 bytes for each."""
    table = words.select("lang_id", F.col("phrase").cast("binary").alias("phrase")).toArrow()
    return Vocabulary(table.column("lang_id").to_numpy(), table.column("phrase").to_pylist())


def phrase_strings(phrases: DataFrame, vocabulary) -> DataFrame:
    """(lang_id, size, phrase, f) from (lang_id, key, rest, f), with the words of the broadcast vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value.strings()
        for batch in batches:
            key, rest = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "rest"))
            ids = [half.astype(np.int64) for both in (unmixed(key), rest) for half in (both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))]
            parts = [words.take(pa.array(i - 1, mask=i == 0)) for i in ids]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", words.type), null_handling="skip")
            size = sum((i > 0).astype(np.int32) for i in ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang_id"), pa.array(size, pa.int32()), phrase.cast(pa.string()), batch.column("f")],
                names=["lang_id", "size", "phrase", "f"])

    return prepared(phrases.select("lang_id", "key", "rest", "f")).mapInArrow(run, "lang_id long, size int, phrase string, f long")


def _joined(words: Column, first: int, length: int) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def scored(phrases: DataFrame, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """(lang_id, phrase, a, l, r, score) from (lang_id, phrase, size, f) of all frequent phrases, single words included.

    Phrases inside a longer one that is nearly as frequent are left out; the weakest cut of each gives its score.
    """
    frequent = phrases.select("lang_id", "phrase", "size", "f")
    words = F.split("phrase", " ")
    parts = frequent.filter("size > 2").select("lang_id", "size", "f", F.explode(F.array_compact(F.array(*[
        F.when((F.col("size") > k) & (F.col("size") >= i + k - 1), _joined(words, i, k))
        for k in (2, 3) for i in range(1, 5 - k + 1)]))).alias("part"))
    longest = parts.groupBy(F.col("lang_id").alias("g"), "part").agg(F.max("f").alias("longer"))
    several = frequent.filter("size > 1")
    kept = several.join(longest, (several["lang_id"] == longest["g"]) & (several["phrase"] == longest["part"]), "left").filter(
        f"longer IS NULL OR cast(longer AS decimal(19,0)) * {ratio[1]} < cast(f AS decimal(19,0)) * {ratio[0]}")
    cuts = kept.select("lang_id", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    sides = cuts.select("lang_id", "phrase", "a", "k", _joined(words, 1, F.col("k")).alias("first"),
                        _joined(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = frequent.select(F.col("lang_id").alias("g"), F.col("phrase").alias("part"), "f")
    for side, name in (("first", "l"), ("rest", "r")):
        sides = sides.join(known, (sides["lang_id"] == known["g"]) & (sides[side] == known["part"])).select(
            *[c for c in sides.columns if c != side], F.col("f").alias(name))
    score = F.expr("cast((cast(2000000 AS decimal(7,0)) * cast(a AS decimal(19,0))) div cast(l + r AS decimal(20,0)) AS bigint)")
    least = sides.withColumn("score", score).groupBy("lang_id", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang_id", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", support: int = 30, top: int = 2000, shards: int = SHARDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of two to four words for each language.

    ``df`` has a text and a language for each document; other columns are left out. A null text has no words, a null
    language is ``und``, repeated rows count each time, ties are ordered by phrase, and an empty table gives no rows.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = stored(word_counts(docs), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n")).filter("n > 0")
    languages = stored(totals.withColumn("lang_id", F.monotonically_increasing_id()), "phrase-languages")
    known = docs.filter("text IS NOT NULL").join(languages.select("lang", "lang_id"), "lang")
    context = df.sparkSession.sparkContext
    sizes = languages.select("lang_id", "n")
    single = stored(words.filter((F.col("f") >= support) & F.col("phrase").isNotNull()).join(
        languages.select("lang", "lang_id"), "lang").select("lang_id", F.lit(1).alias("size"), "phrase", "f"), "phrase-singles")
    vocabulary = context.broadcast(vocabulary_of(single))
    pairs = stored(mine_shards(known, sizes, support, (2,), shards=shards, vocabulary=vocabulary), "phrase-pairs")
    allowed = context.broadcast(bitmap_of(pairs))
    more = mine_shards(known, sizes, support, (3, 4), allowed, shards, vocabulary)
    frequent = stored(phrase_strings(pairs.unionByName(more), vocabulary).unionByName(single), "phrase-counts")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored(frequent).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang_id", "salt").orderBy(*order))).filter(
        F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang_id").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(languages, "lang_id").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
