"""Token ids with the tokenizers library; a text's chunks are encoded once and looked up after that."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

# A chunk is white space and a run of letters, or white space and a run of other characters (with the letters after an
# apostrophe). Byte-level tokenizers of this family never join what stands on both sides of a chunk's start in texts of
# ASCII and these letters; other texts are encoded whole.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
SPACE = "\t-\r "
CHUNK = re.compile(f"[{SPACE}]*(?:[{LETTERS}]+|[^{LETTERS}{SPACE}]+(?:(?<=')[{LETTERS}]+)?)|[{SPACE}]+")
OTHER = re.compile("[\x1c-\x1f]|[^\0-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
# A chunk that such a tokenizer takes as one word, and a character that no chunk of this kind holds.
WORD = re.compile(f" ?[{LETTERS}]+")
MARK = "\x1e"
BUNDLE = 2000
# Chunks that a worker knows before it begins anew.
KEPT = 1_500_000
TOGETHER_BYTES = 1 << 21
GAP = re.compile(rb"[^\t-\r ](?=[\t-\r ])")
POWER = 0x9E3779B97F4A7C15
# White space, letters and others by byte; bytes beyond ASCII are parts of letters in texts without other characters.
KINDS = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if c >= 128 or chr(c).isalpha() else 2 for c in range(256)], np.uint8)


def _byte_letters() -> dict[int, str]:
    """The letter by which tokenizers of this family write each byte: printable ones as they are, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


# First bytes that only other characters have; two more, and those from U+0250 on, begin as letters do.
OTHER_BYTES = bytes([*range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xCA, 0x100)])


def has_others(data: bytes) -> bool:
    """Whether ``OTHER`` finds a character in a text."""
    if len(data.translate(None, OTHER_BYTES)) != len(data):
        return True
    if data.isascii():
        return False
    return b"\xc3\x97" in data or b"\xc3\xb7" in data or b"\xc9" in data and OTHER.search(data.decode("utf-8", "replace")) is not None


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Growing:
    """An array that is added to at its end."""

    def __init__(self, kind: str):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, data: bytes) -> None:
        new = np.frombuffer(data, self.held.dtype)
        if self.n + len(new) > len(self.held):
            more = np.empty(2 * (self.n + len(new)), self.held.dtype)
            more[:self.n] = self.held[:self.n]
            self.held = more
        self.held[self.n:self.n + len(new)] = new
        self.n += len(new)


class Known:
    """Chunks with their ids, sorted by key: where a chunk's text stands and how long it is, where its ids stand and how many."""

    def __init__(self):
        self.keys = np.empty(0, np.uint64)
        self.at, self.sizes, self.firsts, self.counts = (np.empty(0, np.int64) for _ in range(4))
        self.texts, self.ids = Growing("u1"), Growing("<u4")

    def find(self, keys: np.ndarray, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """Places of chunks, -1 for unknown ones; None if a key is that of another chunk. ``keys`` ascend."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[slot] == keys
        here, n = slot[hit], size[hit]
        if (self.sizes[here] != n).any():
            return None
        before = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        if (raw[at + np.repeat(first[hit] - before, n)] != self.texts.held[at + np.repeat(self.at[here] - before, n)]).any():
            return None
        return np.where(hit, slot, -1)

    def add(self, keys: np.ndarray, chunks: list[bytes], codes: list[bytes]) -> None:
        """Add unknown chunks; ``keys`` ascend."""
        place = np.searchsorted(self.keys, keys)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        counts = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        self.at = np.insert(self.at, place, self.texts.n + np.cumsum(sizes) - sizes)
        self.firsts = np.insert(self.firsts, place, self.ids.n + np.cumsum(counts) - counts)
        self.sizes, self.counts = np.insert(self.sizes, place, sizes), np.insert(self.counts, place, counts)
        self.keys = np.insert(self.keys, place, keys)
        self.texts.add(b"".join(chunks))
        self.ids.add(b"".join(codes))


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = self._word_tokenizer(path)
        self.model = self.tokenizer.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.powers = self.back = np.ones(0, np.uint64)
        self.known = Known()

    @property
    def new(self) -> list[str]:
        """The chunks that are known."""
        known, text = self.known, self.known.texts.held
        return [text[a:a + n].tobytes().decode() for a, n in zip(known.at.tolist(), known.sizes.tolist(), strict=True)]

    def _word_tokenizer(self, path: str) -> Tokenizer:
        """The same tokenizer without its search for words, where that is the byte-level one."""
        words = Tokenizer.from_file(path)
        own = words.pre_tokenizer
        kind = {} if own is None else json.loads(own.__getstate__())
        self.byte_level = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space")
        if self.byte_level:
            words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return words

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of chunks that are one word each: straight from the library's model where nothing stands before it."""
        if not self.byte_level or self.tokenizer.normalizer is not None:
            return self._encoded(pieces, self.words)
        tokenize, code = self.model.tokenize, self.id_bytes
        shown = MARK.join(pieces).encode().decode("latin-1").translate(BYTE_LETTERS).split(BYTE_LETTERS[ord(MARK)])
        return [b"".join([code[t.id] for t in tokenize(word)]) for word in shown] if pieces else []

    def _encoded(self, pieces: list[str], tokenizer: Tokenizer) -> list[bytes]:
        """Ids of chunks; a bundle of them, with a mark after each, shares one result of the library."""
        if self.mark is None:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        out = []
        for at in range(0, len(pieces), BUNDLE):
            marked = [x for piece in pieces[at:at + BUNDLE] for x in (piece, MARK)]
            found = tokenizer.encode_batch_fast([marked], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark) * 4).tolist()
            out += [raw[start:end] for start, end in zip([0] + [end + 4 for end in ends], ends)]
        return out

    def _learned(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without other characters, in order."""
        words = [WORD.fullmatch(c) is not None for c in chunks]
        plain = iter(self._words([c for c, word in zip(chunks, words, strict=True) if word]))
        mixed = iter(self._encoded([c for c, word in zip(chunks, words, strict=True) if not word], self.tokenizer))
        return [next(plain if word else mixed) for word in words]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return self._together([text.encode()])[0]

    def many(self, given: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        return self.many_raw([text.encode() for text in given])

    def many_raw(self, given: list[bytes]) -> Iterator[bytes]:
        """The same for texts in UTF-8; a few million bytes are looked up together."""
        at = 0
        while at < len(given):
            end, size = at, 0
            while end < len(given) and (size := size + len(given[end])) <= TOGETHER_BYTES:
                end += 1
            yield from self._together(given[at:max(end, at + 1)])
            at = max(end, at + 1)

    def _together(self, given: list[bytes]) -> list[bytes]:
        out = [None if any(t in data for t in self.special) or has_others(data) else b"" for data in given]
        pieces = [(i, piece) for i, code in enumerate(out) if code is not None for piece in _pieces(given[i])]
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= TOGETHER_BYTES):
                size, end = size + len(pieces[end][1]), end + 1
            for (i, _), code in zip(pieces[at:end], self._looked_up([p for _, p in pieces[at:end]]), strict=True):
                out[i] = out[i] + code if out[i] else code
            at = end
        return [self._alone(data.decode("utf-8", "replace")) if code is None else code for data, code in zip(given, out, strict=True)]

    def _looked_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces without other characters: their chunks are found, told apart and put together as arrays."""
        data = b"".join(pieces)
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        if not len(raw):
            return [b""] * len(pieces)
        firsts = np.concatenate([[0], ends[:-1]])
        starts = _chunk_starts(raw, firsts[firsts < ends])
        sizes = np.diff(np.append(starts, len(raw)))
        # Equal chunks have equal sums of their bytes over powers of a number; that they are equal is then looked at.
        keys, index, kind = np.unique(self._sums(raw, starts, sizes), return_index=True, return_inverse=True)
        first, size = starts[index], sizes[index]
        same = (sizes == size[kind]).all() and (raw[np.arange(len(raw)) + np.repeat(first[kind] - starts, sizes)] == raw).all()
        if same and len(self.known.keys) > KEPT:
            self.known = Known()
        slot = self.known.find(keys, raw, first, size) if same else None
        if slot is None:
            return [self._alone(p.decode()) for p in pieces]
        if (slot < 0).any():
            new = np.flatnonzero(slot < 0)
            chunks = [data[a:b] for a, b in zip(first[new].tolist(), (first + size)[new].tolist(), strict=True)]
            self.known.add(keys[new], chunks, self._learned([c.decode() for c in chunks]))
            slot = np.searchsorted(self.known.keys, keys)
        here = self.known.counts[slot][kind]
        upto = np.cumsum(here)
        place = np.repeat(self.known.firsts[slot][kind] - (upto - here), here)
        whole = self.known.ids.held[np.arange(len(place)) + place].tobytes()
        cuts = np.concatenate([[0], upto])[np.searchsorted(starts, np.append(firsts, len(raw)))] * 4
        return [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _sums(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(raw):
            self.powers, self.back = _powers(POWER, len(raw)), _powers(pow(POWER, -1, 1 << 64), len(raw))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:len(raw)])])
        return (before[starts + sizes] - before[starts]) * self.back[starts]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _chunk_starts(raw: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the chunks of ``CHUNK`` start in texts without other characters, which begin at ``firsts``.

    A run of white space, letters or others starts a chunk, unless white space stands before it, or the run is letters
    after an apostrophe.
    """
    kind = KINDS[raw]
    before, last = np.empty_like(kind), np.empty_like(raw)
    before[0], last[0] = 0, 0
    before[1:], last[1:] = kind[:-1], raw[:-1]
    goes_on = (before == 0) | ((kind == 1) & (before == 2) & (last == 39))
    begins = (kind != before) & ((kind == 0) | ~goes_on)
    begins[firsts] = True
    return np.flatnonzero(begins)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end before white space, where a chunk starts."""
    at = 0
    while len(data) - at > TOGETHER_BYTES and (gap := GAP.search(data, at + TOGETHER_BYTES // 2)):
        yield data[at:gap.end()]
        at = gap.end()
    yield data[at:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
