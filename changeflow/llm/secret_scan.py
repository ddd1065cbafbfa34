"""Secret scans: a keyword automaton finds places, anchored patterns match there, embedded checksums confirm."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeflow.llm.common import append_columns, code_points, field, texts

# Kinds in order, each with the words that start it and its pattern.
PATTERNS = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": (("akia",), r"(?-i:AKIA[A-Z0-9]+)"),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?-i:gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9]))"),
    "npm": (("npm_",), r"(?-i:npm_[A-Za-z0-9]{36}(?![A-Za-z0-9]))"),
    "jwt": (("eyj",), r"(?-i:[A-Za-z0-9_-]*)"),
    "private_key": (("-----begin",), r"(?-i:-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]{64,})-----END)"),
}
BASE = ("assign", "access", "hex")
ORDER = ["assign", "access", "hex", "github", "npm", "jwt", "private_key"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
OPENSSH_MAGIC = b"openssh-key-v1\0"
# Ciphers that append a tag, outside of all length fields.
OPENSSH_SEALED, OPENSSH_TAG = (b"aes128-gcm", b"aes256-gcm", b"chacha20-poly1305"), 16
HEX_LENGTH = 32
HEX_CLASS = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))


def base62(number: int, width: int) -> str:
    digits = ""
    while number:
        number, rest = divmod(number, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(width, "0")


def _checksum62(secret: str) -> bool:
    """The last six characters are the CRC-32 of the thirty after the prefix."""
    body = secret[4:]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


class Tokens:
    """JWTs of a text: header, payload and signature are whole runs of the class between dots, but a header may start
    inside its run, after a prefix. A run's ends and its decoded forms are found once, however many places it has."""

    HEADER, PAYLOAD, SIGNATURE = 11, 8, 16

    def __init__(self, text: str, run: re.Pattern):
        self.text, self.run, self.runs = text, run, {}
        self.head_end = self.end = -1
        self.heads: dict[int, tuple[int, str, int, np.ndarray | None] | None] = {}

    def _run_end(self, start: int) -> int:
        if start not in self.runs:
            self.runs[start] = self.run.match(self.text, start).end()
        return self.runs[start]

    def match(self, start: int) -> int:
        """The end of the token whose header starts here, or -1."""
        if start >= self.head_end:
            self.head_end, self.end, self.heads = self._run_end(start), -1, {}
            parts = [self.head_end]
            for least in (self.PAYLOAD, self.SIGNATURE):
                at = parts[-1]
                if self.text[at:at + 1] != "." or self._run_end(at + 1) - at - 1 < least:
                    break
                parts.append(self._run_end(at + 1))
            else:
                self.end = parts[-1]
        if self.end < 0 or self.head_end - start < self.HEADER or not self.text.startswith("eyJ", start):
            return -1
        return self.end if self._names_algorithm(start) else -1

    def _names_algorithm(self, start: int) -> bool:
        """The header decodes to JSON that names an algorithm. Starts four letters apart share their decoded form."""
        phase = (self.head_end - start) % 4
        if phase not in self.heads:
            self.heads[phase] = None
            if phase != 1:
                raw = base64.urlsafe_b64decode(self.text[start:self.head_end] + "=" * (-phase % 4))
                decoded = raw.decode("utf-8", "surrogateescape").rstrip(" \t\r\n")
                if decoded.endswith("}") and '"' in decoded:
                    bad = max((m.end() for m in re.finditer("[\udc80-\udcff]", decoded)), default=0)
                    places = np.cumsum([0, *map(len, map(_utf8, decoded))]) if not decoded.isascii() else None
                    self.heads[phase] = (start, decoded, bad, places)
        if self.heads[phase] is None:
            return False
        first, decoded, bad, places = self.heads[phase]
        at = (start - first) // 4 * 3
        if places is not None:
            at = int(np.searchsorted(places, at))
        if at < bad:
            return False
        try:
            found, end = json.JSONDecoder().raw_decode(decoded, at)
        except (ValueError, RecursionError):
            return False
        return end == len(decoded) and isinstance(found, dict) and "alg" in found


def _utf8(character: str) -> bytes:
    return character.encode("utf-8", "surrogateescape")


def _decoded(body: str) -> bytes:
    try:
        return base64.b64decode("".join(body.split()), validate=True)
    except ValueError:
        return b""


def _openssh(body: str) -> bool:
    """The decoded key has OpenSSH's magic, and the length fields of its parts cover the rest exactly."""
    raw = _decoded(body)
    at = len(OPENSSH_MAGIC)
    if not raw.startswith(OPENSSH_MAGIC):
        return False

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(raw[at - 4:at], "big") if at <= len(raw) else len(raw)

    def part() -> bytes:
        nonlocal at
        size = number()
        at += size
        return raw[at - size:at]

    cipher, _, _ = part(), part(), part()
    keys = number()
    for _ in range(keys):
        if at >= len(raw):
            return False
        part()
    private = part()
    tag = OPENSSH_TAG if cipher.startswith(OPENSSH_SEALED) else 0
    return keys > 0 and len(private) >= 8 and at + tag == len(raw)


def _der(body: str) -> bool:
    """The decoded key is one DER sequence whose own length field covers it exactly."""
    der = _decoded(body)
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return der[1] + 2 == len(der)
    size = der[1] & 0x7F
    return int.from_bytes(der[2:2 + size], "big") + 2 + size == len(der)


VALID = {
    "assign": lambda m: len(m[1]) >= 8, "access": lambda m: len(m[0]) >= 16, "github": lambda m: _checksum62(m[0]),
    "npm": lambda m: _checksum62(m[0]), "private_key": lambda m: _der(m[1]) or _openssh(m[1]),
}


@lru_cache(maxsize=1)
def _scanner():
    words = ahocorasick.Automaton()
    for kind, (keys, _) in PATTERNS.items():
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()
    return words, {k: re.compile(p, re.ASCII | re.IGNORECASE) for k, (_, p) in PATTERNS.items()}


def hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of whole runs of at least 32 hexadecimal digits; the keyword is the run itself, by class."""
    classes = raw.translate(HEX_CLASS)
    found, at = [], classes.find(b"x" * HEX_LENGTH)
    while at >= 0:
        end = at + HEX_LENGTH
        while end < len(raw) and classes[end] == 120:
            end += 1
        found.append((at, end))
        at = classes.find(b"x" * HEX_LENGTH, end)
    return found


def find_secrets(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    words, patterns = _scanner()
    lower = raw.lower().decode("utf-8", "replace")
    hits = sorted((end - size + 1, kind) for end, (kind, size) in words.iter(lower))
    runs = hex_runs(raw)
    if not hits and not runs:
        return []
    text = raw.decode("utf-8", "replace")
    spans, reached = [], {}
    tokens = Tokens(text, patterns["jwt"])
    for start, kind in hits:
        if start < reached.get(kind, 0):
            continue
        if kind == "jwt":
            end = tokens.match(start)
            if end >= 0:
                reached[kind] = end
                spans.append((start, end, kind))
            continue
        match = patterns[kind].match(text, start)
        if match:
            reached[kind] = match.end()
            if VALID[kind](match):
                spans.append((start, match.end(), kind))
    reached, start = 0, 0
    for a, b in runs:
        # Code points between neighbouring runs, so that the text is counted once.
        start += code_points(raw[reached:a])
        spans.append((start, start + b - a, "hex"))
        reached = a
    return sorted(spans, key=lambda s: (s[0], ORDER.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each stretch of overlapping spans becomes ``[kind]`` of its first span."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FIELDS = [
    field("n_assign", "long"), field("n_access", "long"), field("n_hex", "long"), field("base_sha256", "string"),
    field("spans", "string"), field("n_secrets", "long"),
]


def scan_secrets(df: DataFrame, text: str = "text", redacted: str | None = None) -> DataFrame:
    """All columns of ``df`` and the secrets of each row's whole text; ``redacted`` names a column for the text without them.

    Kinds assign, access and hex are found by pattern alone; github and npm tokens need their CRC-32, a JWT a decodable
    header, which may stand straight after other letters, and a private key a DER length or OpenSSH lengths that fit. A null or empty text has none; its redacted text is as it was.
    Repeated rows are scanned one by one; columns of ``df`` with a result's name are replaced; an empty table stays empty.
    Rows are independent, so nothing is shuffled.
    """
    fields = FIELDS + ([field(redacted, "string")] if redacted else [])

    def make(batch: pa.RecordBatch) -> list[list]:
        out: list[list] = [[] for _ in fields]
        for raw in texts(batch, text):
            spans = find_secrets(raw) if raw else []
            base = [s for s in spans if s[2] in BASE]
            row = [sum(s[2] == k for s in spans) for k in BASE]
            row += [hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), len(spans)]
            if redacted:
                row.append(None if raw is None else redact(raw.decode("utf-8", "replace"), spans))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    return append_columns(df, fields, make)
