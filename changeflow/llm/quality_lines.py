"""Line-first cleaning: rules judge single lines, failing lines go, then documents that lost too much text go."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import append_columns, code_points, field, texts

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
TERMINAL = (".", "!", "?", "…", ":", ";", "\"", "'", ")", "]", "»", "”", "’", "。", "！", "？", "؟", "।")
TERMINAL_BYTES = tuple(c.encode() for c in TERMINAL)
SEPARATORS = {c.encode() for c in ("|", "||", ">", ">>", "»", "›", "•", "·", "/", "::")}
SENTENCE_END = re.compile(rb"[.!?]['\")]*[ \t]")
MARK_RUN = re.compile(rb"[#*$%&|<>!?~^=_]{2,}")
BOILERPLATE = re.compile(
    rb"(?i)lorem ipsum|enable javascript|uses? cookies|cookie policy|privacy policy|terms of (?:use|service)"
    rb"|all rights reserved|click here|read more|sign up|log ?in to|subscribe to|share (?:this|on)|skip to content"
)


@dataclass(frozen=True)
class LineRules:
    """``sentence``: words for which a line that ends without a sentence's end needs one inside. ``marked``: share of a line's words with runs of marks. ``separators``: share of a line's words that only
    separate. ``least_kept``: share of the document's words that must stay. ``least_words``: fewest words."""

    sentence: int = 50
    marked: float = 0.3
    separators: float = 0.2
    least_kept: float = 0.5
    least_words: int = 20
    window: int = 8
    most_repeated: float = 0.3


def failed_rule(line: bytes, words: list[bytes], rules: LineRules) -> str | None:
    """The first rule that a line with words breaks: punctuation, navigation or boilerplate."""
    n = len(words)
    if not line.rstrip(WHITE).endswith(TERMINAL_BYTES) and len(SENTENCE_END.findall(line)) * rules.sentence < n:
        return "punctuation"
    if len(MARK_RUN.findall(line)) > rules.marked * n:
        return "punctuation"
    if sum(w in SEPARATORS for w in words) > rules.separators * n:
        return "navigation"
    return "boilerplate" if BOILERPLATE.search(line) else None


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of ``window`` words that the text has at least twice, first ones included."""
    n = len(words)
    if n <= window:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - window + 1
    rolled = np.zeros(m, np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + m]
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    at = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(at):
        return 0
    a, b = order[at], order[at + 1]
    same = np.ones(len(at), bool)
    for j in range(window):
        same &= ids[a + j] == ids[b + j]
    hit = np.zeros(m, bool)
    hit[a[same]] = hit[b[same]] = True
    steps = np.zeros(n + 1, np.int32)
    steps[:m] += hit
    steps[window:] -= hit
    return int((np.cumsum(steps[:n]) > 0).sum())


def judge(text: bytes | None, rules: LineRules) -> tuple:
    """Counts of one text, whether the base rules fail it, the verdict, and the text without failing lines."""
    text = text or b""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    repeats, left, kept_words = 0, [], 0
    fails = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        rule = failed_rule(line, own, rules)
        if rule:
            fails[rule] += 1
        else:
            left.append(line)
            kept_words += len(own)
    in_repeats = repeated_words(words, rules.window)
    base_failed = n < rules.least_words or in_repeats > rules.most_repeated * n
    kept = not base_failed and kept_words >= rules.least_kept * n and kept_words >= rules.least_words
    return (
        n, code_points(text.translate(None, WHITE)), len(text) - len(text.translate(None, SYMBOLS)), repeats, in_repeats,
        base_failed, kept, fails["punctuation"], fails["navigation"], fails["boilerplate"], n - kept_words, b"\n".join(left),
    )


FIELDS = [
    *(field(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    field("base_failed", "boolean"), field("kept", "boolean"),
    *(field(c, "long") for c in ("n_punctuation_lines", "n_navigation_lines", "n_boilerplate_lines", "n_lost_words")),
    field("clean_text", "string"),
]


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """All columns of ``df``, the counts and verdict of each row's whole text, and ``clean_text``.

    A null or empty text has no words and is rejected. Repeated rows are judged one by one. Columns of ``df`` that have
    the name of a result are replaced. An empty table stays empty. There is no shuffle: a row needs no other.
    """

    def make(batch: pa.RecordBatch) -> list[list]:
        rows = [judge(t, rules) for t in texts(batch, text)]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in FIELDS]
        columns[-1] = [t.decode("utf-8", "replace") for t in columns[-1]]
        return columns

    return append_columns(df, FIELDS, make)


def accepted(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Only accepted documents, with the columns of ``df`` and the failing lines removed from their texts."""
    marked = clean_lines(df.withColumns({"__keep_" + f.name: F.col(f.name) for f in FIELDS if f.name in df.columns}), text, rules)
    back = [
        F.col("clean_text").alias(c) if c == text
        else F.char_length("clean_text").cast(df.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("__keep_" + c).alias(c) if "__keep_" + c in marked.columns else F.col(c)
        for c in df.columns
    ]
    return marked.filter("kept").select(*back)
