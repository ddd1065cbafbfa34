"""Vector bin packing: sequences under limits on tokens, segments and loss-bearing tokens, filled by dot product.

A task packs its own documents, so nothing is shuffled and no key or copy can make a group large. Full-length pieces are
sequences of their own. The rests wait in a bounded pool; a sequence takes, again and again, the fitting rest whose
demand vector has the largest dot product with what the sequence still has room for. A gap that no rest fits is filled
by cutting one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changeflow.llm.common import prepared, texts
from changeflow.llm.tokens import default_tokenizer, encoder

# Rests that wait at most; half of them are left in the pool until the task's end, as choice for the next sequences.
POOL = 4096
# How byte-level tokenizers write a line break.
LINE_BREAK = "\u010a"


@dataclass(frozen=True)
class Limits:
    """``gap``: tokens that may stay empty before a rest is cut to fill them."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2016
    gap: int = 16


@dataclass
class Item:
    """Ids ``start`` to ``end`` of those held; ``sums`` has the loss-bearing ids before each place.

    What is held is an example of ``total`` ids, or a slice of it that begins at its place ``base``.
    """

    key: object
    ids: np.ndarray
    sums: np.ndarray
    start: int
    end: int
    base: int
    total: int

    def rest(self, start: int) -> Item:
        """The ids from ``start`` on without those before, so that a waiting rest holds no whole example."""
        own = slice(start, self.end)
        return Item(self.key, self.ids[own].copy(), self.sums[start:self.end + 1] - self.sums[start], 0, self.end - start,
                    self.base + start, self.total)

    def loss(self, start: int, end: int) -> int:
        return int(self.sums[end] - self.sums[start])

    def most(self, start: int, tokens: int, loss: int) -> int:
        """Where a piece from ``start`` must end to stay within both limits."""
        end = min(self.end, start + tokens)
        return min(end, int(np.searchsorted(self.sums, self.sums[start] + loss, side="right")) - 1)


class Packer:
    """Packs the items of one task; ``emit`` gets (item, start, end, sequence, offset, segment)."""

    def __init__(self, limits: Limits, emit: Callable[..., None], first: int = 0):
        self.limits, self.emit, self.sequence = limits, emit, first
        self.pool: dict[tuple[int, int], list[Item]] = {}
        self.waiting = 0

    def add(self, item: Item) -> None:
        limits, start = self.limits, item.start
        while True:
            end = item.most(start, limits.tokens, limits.loss)
            if end <= start:
                end = start + 1  # a single id that bears more loss than is allowed
            if end == item.end and end - start < limits.tokens:
                break
            self.emit(item, start, end, self.sequence, 0, 0)
            self.sequence += 1
            start = end
            if start == item.end:
                return
        self._wait(item.rest(start))
        if self.waiting >= POOL:
            self._fill(POOL // 2)

    def finish(self) -> None:
        self._fill(0)

    def _wait(self, item: Item) -> None:
        self.pool.setdefault((item.end - item.start, item.loss(item.start, item.end)), []).append(item)
        self.waiting += 1

    def _take(self, shape: tuple[int, int]) -> Item:
        items = self.pool[shape]
        item = items.pop()
        if not items:
            del self.pool[shape]
        self.waiting -= 1
        return item

    def _fill(self, leave: int) -> None:
        limits = self.limits
        most = np.array([limits.tokens, limits.segments, max(1, limits.loss)], float)
        shapes = np.array(sorted(self.pool), np.int64).reshape(-1, 2)
        left = np.array([len(self.pool[tuple(s)]) for s in shapes.tolist()], np.int64)
        while self.waiting > leave:
            room = np.array([limits.tokens, limits.segments, limits.loss])
            offset = 0
            while room[1] > 0 and self.waiting:
                fits = (left > 0) & (shapes[:, 0] <= room[0]) & (shapes[:, 1] <= room[2])
                if not fits.any():
                    break
                weight = room / most
                score = shapes[:, 0] / most[0] * weight[0] + weight[1] / most[1] + shapes[:, 1] / most[2] * weight[2]
                best = int(np.where(fits, score, -1.0).argmax())
                left[best] -= 1
                item = self._take(tuple(shapes[best].tolist()))
                self.emit(item, item.start, item.end, self.sequence, offset, limits.segments - int(room[1]))
                offset += item.end - item.start
                room -= [item.end - item.start, 1, item.loss(item.start, item.end)]
            if self.waiting and room[1] > 0 and (room[0] > limits.gap or not offset):
                best = int(np.where(left > 0, shapes[:, 0], -1).argmax())
                item = self._take(tuple(shapes[best].tolist()))
                left[best] -= 1
                cut = item.most(item.start, int(room[0]), int(room[2]))
                if cut <= item.start and not offset:
                    cut = item.start + 1
                if cut > item.start:
                    self.emit(item, item.start, cut, self.sequence, offset, limits.segments - int(room[1]))
                if item.end > cut:
                    rest = item.rest(cut)
                    shape = (rest.end - rest.start, rest.loss(rest.start, rest.end))
                    self._wait(rest)
                    at = np.flatnonzero((shapes == shape).all(axis=1))
                    if len(at):
                        left[at[0]] += 1
                    else:
                        shapes, left = np.vstack([shapes, shape]), np.append(left, 1)
            self.sequence += 1


@lru_cache(maxsize=2)
def _line_ends(path: str) -> np.ndarray:
    """Whether an id's text holds a line break."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, number in tokenizer.get_vocab().items():
        ends[number] = LINE_BREAK in token
    return ends


def _plain_sums(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Loss-bearing ids before each place: a document's first line is its prompt, and all that follows bears loss.

    A document of one line has its first id as its prompt.
    """
    prompt = 1
    for at in range(0, len(ids) - 1, 1024):
        breaks = np.flatnonzero(ends[ids[at:min(at + 1024, len(ids) - 1)]])
        if len(breaks):
            prompt = at + int(breaks[0]) + 1
            break
    sums = np.arange(-prompt, len(ids) - prompt + 1, dtype=np.int64)
    sums[:prompt] = 0
    return sums


RESULTS = [
    ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()),
    ("doc_tokens", T.LongType(), pa.int64()), ("sequence_id", T.LongType(), pa.int64()), ("offset", T.LongType(), pa.int64()),
    ("segment", T.IntegerType(), pa.int32()), ("n_loss", T.LongType(), pa.int64()),
]
FLUSH = 4096


def _packed(df: DataFrame, key: str, limits: Limits, read: Callable, with_ids: bool) -> DataFrame:
    fields = [T.StructField(key, df.schema[key].dataType)] + [T.StructField(n, t) for n, t, _ in RESULTS]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind = None

        def emit(item, start, end, sequence, offset, segment):
            part = item.ids[start:end]
            row = (item.key, item.base + start, end - start, zlib.crc32(part.astype("<u4").tobytes()), item.total, sequence, offset,
                   segment, item.loss(start, end))
            rows.append((*row, part.astype(np.int32)) if with_ids else row)

        def flush():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            made = [pa.array(columns[0], kind)] + [pa.array(c, k) for c, (_, _, k) in zip(columns[1:], RESULTS, strict=False)]
            if with_ids:
                made.append(pa.array(columns[-1], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(made, names=names)

        packer = Packer(limits, emit, TaskContext.get().partitionId() << 33)
        for batch in batches:
            kind = batch.column(key).type
            for item in read(batch):
                packer.add(item)
                if len(rows) >= FLUSH:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return prepared(df).mapInArrow(run, T.StructType(fields))


def pack_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits(), end_id: int = 1,
    tokenizer: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Tokenise whole texts, end each with ``end_id`` and pack them; one row for each piece of a document.

    A piece has its document's key, its place in the document (``start``, ``length``), the CRC-32 of its ids, its
    sequence, its ``offset`` and ``segment`` there, its loss-bearing ids (all after a document's first line, which is its
    prompt, or after its first id if it has one line), and the ids themselves if wanted. A null or empty text is its end id alone. Repeated rows and null keys are packed like others;
    other columns of ``df`` are left out. An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()

    def read(batch: pa.RecordBatch):
        ends = _line_ends(path)
        codes = encoder(path).many_raw([raw or b"" for raw in texts(batch, text)])
        for name, code in zip(batch.column(key).to_pylist(), codes, strict=True):
            ids = np.frombuffer(code + end_id.to_bytes(4, "little"), "<u4")
            yield Item(name, ids, _plain_sums(ids, ends), 0, len(ids), 0, len(ids))

    return _packed(df.select(key, text), key, limits, read, with_ids)


def pack_examples(
    df: DataFrame, key: str = "example_id", ids: str = "ids", loss: str = "loss", limits: Limits = Limits(),
    with_ids: bool = False,
) -> DataFrame:
    """Pack instruction examples that are tokenised already: ``ids`` array<int>, ``loss`` array<boolean> of equal length.

    A null or short ``loss`` counts as false where it is missing; a null or empty ``ids`` has no piece.
    """

    def read(batch: pa.RecordBatch):
        columns = [batch.column(c).to_pylist() for c in (key, ids, loss)]
        for name, own, marks in zip(*columns, strict=True):
            if own:
                bears = np.zeros(len(own) + 1, np.int64)
                marks = np.array([bool(m) for m in marks or ()][:len(own)], np.int64)
                bears[1:len(marks) + 1] = marks
                yield Item(name, np.array(own, "<u4"), np.cumsum(bears), 0, len(own), 0, len(own))

    return _packed(df.select(key, ids, loss), key, limits, read, with_ids)
