"""Language ID by cross-parsing: a text is cut into longest phrases that a language's sample contains; fewest phrases win.

The sample of a language is turned into a suffix automaton, which accepts exactly the sample's substrings. Walking a
text through it, a phrase ends where the automaton has no further step. Phrase counts are normalised by text length and
sample size, as in cross-entropy: ``phrases * log2(sample length) / text length``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import append_columns, field, texts

# Bound of the labelled sample: characters for each language, and for all languages together.
SAMPLE_CHARS = 32_768
SAMPLE_CHARS_TOTAL = 1 << 20
# A sampled document gives at most this many characters, so that the sample has many documents.
DOCUMENT_CHARS = 2_048
# Symbols of a language whose steps are a dense table, its most frequent letters; steps of all others are looked up.
DENSE = 64
# Smaller samples are normalised as if they had this many characters; else few characters would make phrases cheap.
SMALL_SAMPLE = 1_024
# Texts are walked in pieces of this length, each from the start state, many pieces at once.
PIECE = 128
SPACE, UNKNOWN = 0, 1


def normal(text: str) -> str:
    """Lower case; runs of anything but letters become one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, str]:
    """A bounded sample of normalised text for each language that ``labelled`` has.

    One pass counts the characters of each language; a hash of key and text then admits rows at the rate that gives
    about one and a half times ``SAMPLE_CHARS``. At most that reaches the driver, whatever the table's size. Rows with a
    null language or text teach nothing; equal texts are used once.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.substring(text, 1, DOCUMENT_CHARS).alias("part"),
        F.xxhash64(F.col(key), F.col(text)).alias("rank"))
    totals = {r["lang"]: r["chars"] for r in
              rows.groupBy("lang").agg(F.sum(F.char_length("part")).alias("chars")).collect() if r["chars"]}
    if not totals:
        return {}
    each = min(SAMPLE_CHARS, SAMPLE_CHARS_TOTAL // len(totals))
    rate = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, 1.5 * each / n))])[F.col("lang")]
    chosen = rows.filter(F.pmod("rank", F.lit(1_000_003)) < rate * 1_000_003).select("lang", "rank", "part").collect()
    samples: dict[str, str] = {}
    for row in sorted(chosen, key=lambda r: (r["lang"], r["rank"], r["part"])):
        have, more = samples.setdefault(row["lang"], ""), normal(row["part"])
        if len(have) < each and more and more not in have:
            samples[row["lang"]] = (have + " " + more)[:each].strip()
    return {k: v for k, v in samples.items() if v}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Steps of the automaton of all substrings, symbol to state for each state; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


class Steps:
    """An automaton for many walks at once: dense for symbols under ``width``, sorted (state, symbol) pairs for the rest."""

    def __init__(self, symbols: list[int], width: int):
        steps = suffix_automaton(symbols)
        self.width = width
        self.table = np.full((len(steps), width), -1, np.int32)
        rare = []
        for state, out in enumerate(steps):
            for c, to in out.items():
                if c < width:
                    self.table[state, c] = to
                else:
                    rare.append((state << 32 | c, to))
        rare.sort()
        self.pairs = np.array([k for k, _ in rare], np.int64)
        self.to = np.array([v for _, v in rare], np.int32)

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states, -1 for no step."""
        if not len(self.pairs):
            return self.table[state, c]
        to = self.table[state, np.where(c < self.width, c, UNKNOWN)]
        other = np.flatnonzero(c >= self.width)
        if len(other):
            pair = state[other].astype(np.int64) << 32 | c[other]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            to[other] = np.where(self.pairs[at] == pair, self.to[at], -1)
        return to


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """All code points that are letters."""
    return np.fromiter((c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()), np.int64)


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]):
    """Symbol of each code point, and for each language its own symbols by those, its steps and its size; built once in a
    worker.

    Every letter of the samples has a symbol. A language numbers those that it has by frequency; to it, all others are
    ``UNKNOWN``, from which no state has a step.
    """
    points = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for _, s in samples]
    letters = np.unique(np.concatenate(points))
    letters = letters[letters != ord(" ")]
    symbol = np.full(0x110000, SPACE, np.int32)
    symbol[_letters()] = UNKNOWN
    symbol[letters] = np.arange(2, len(letters) + 2)
    kind = np.uint8 if len(letters) + 2 <= 1 << 8 else np.uint16 if len(letters) + 2 <= 1 << 16 else np.int32
    symbol = symbol.astype(kind)
    languages = []
    for own in points:
        codes = symbol[own]
        seen = np.bincount(codes, minlength=len(letters) + 2)
        seen[[SPACE, UNKNOWN]] = 0
        order = np.argsort(-seen, kind="stable")[:np.count_nonzero(seen)]
        local = np.full(len(letters) + 2, UNKNOWN, kind)
        local[SPACE] = SPACE
        local[order] = np.arange(2, len(order) + 2)
        languages.append((local, Steps(local[codes].tolist(), min(DENSE, len(order) + 2)), len(own)))
    return symbol, languages


def phrases(codes: np.ndarray, starts: np.ndarray, steps: Steps) -> np.ndarray:
    """Phrases of each piece; a piece begins at ``starts`` and ends at the next start. Pieces advance together."""
    ends = np.append(starts[1:], len(codes))
    order = np.argsort(-(ends - starts), kind="stable")
    begin, size = starts[order], (ends - starts)[order]
    state = np.zeros(len(begin), np.int32)
    count = np.ones(len(begin), np.int64)
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
    for step, n in enumerate(alive.tolist()):
        c = codes[begin[:n] + step]
        to = steps.follow(state[:n], c)
        stuck = np.flatnonzero(to < 0)
        if len(stuck):
            fresh = stuck[state[stuck] != 0]
            count[fresh] += 1
            again = steps.follow(np.zeros(len(stuck), np.int32), c[stuck])
            lost = stuck[again < 0]
            to[stuck] = np.maximum(again, 0)
            if step + 1 < len(alive):
                more = lost[lost < alive[step + 1]]
                count[more] += 1
        state[:n] = to
    out = np.empty(len(begin), np.int64)
    out[order] = count
    return out


def parse_counts(raw: list[bytes], samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and spaces of each text, and its normalised phrase counts for each language."""
    symbol, languages = _model(samples)
    codes, lengths = [], []
    for text in raw:
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        c = symbol[points]
        blank = c == SPACE
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        c = c[keep]
        codes.append(c if (c != SPACE).any() else c[:0])
        lengths.append(len(codes[-1]))
    lengths = np.array(lengths, np.int64)
    score = np.zeros((len(raw), len(languages)))
    pieces = -(-lengths // PIECE)
    if not pieces.sum():
        return lengths, score
    flat = np.concatenate(codes)
    owner = np.repeat(np.arange(len(raw)), pieces)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[owner] + within * PIECE
    for i, (local, steps, size) in enumerate(languages):
        found = np.bincount(owner, weights=phrases(local[flat], starts, steps), minlength=len(raw))
        score[:, i] = found * np.log2(max(SMALL_SAMPLE, size)) / np.maximum(1, lengths)
    return lengths, score


FIELDS = [field("lang_pred", "string"), field("score", "double"), field("n_letters", "long"), field("entropy", "double")]


def predict(df: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """All columns of ``df``, ``lang_pred``, ``score`` (0.5 to 1: the second-best entropy's share of the two best; 1 with
    one language), the parsed length and the winner's entropy in bits a character.

    A null text, one without a letter, or no learned language gives ``und`` and score 0. A tie goes to the first language
    by name. Whole texts are parsed; repeated rows one by one; columns of ``df`` with a result's name are replaced.
    """
    model = tuple(sorted(samples.items()))
    names = [k for k, _ in model]

    def make(batch: pa.RecordBatch) -> list[list]:
        raw = [t or b"" for t in texts(batch, text)]
        if not model:
            return [["und"] * len(raw), [0.0] * len(raw), [0] * len(raw), [None] * len(raw)]
        lengths, scores = parse_counts(raw, model)
        best = scores.argmin(axis=1)
        low = scores.min(axis=1)
        second = np.partition(scores, 1, axis=1)[:, 1] if len(model) > 1 else None
        share = second / np.maximum(low + second, 1e-300) if second is not None else np.ones(len(raw))
        ok = lengths > 0
        return [
            [names[b] if y else "und" for b, y in zip(best.tolist(), ok.tolist(), strict=True)],
            np.where(ok, share, 0.0).tolist(), lengths.tolist(),
            [v if y else None for v, y in zip(low.tolist(), ok.tolist(), strict=True)],
        ]

    return append_columns(df, FIELDS, make)


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
