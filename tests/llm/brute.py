"""Plain versions of the operators, written from their definitions."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def secrets(text):
    text = text or ""
    found = []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return [sum(f[2] == k for f in found) for k in ("assign", "access", "hex")] + [hashlib.sha256(listed.encode()).hexdigest()], listed


def benchmark(text, items, size=10):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        windows = [w[i:i + size] for i in range(max(1, len(w) - size + 1))] if w else []
        for window in windows:
            for i in range(len(own) - len(window) + 1):
                if own[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names.add(str(name) if name is not None else "")
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def licenses(text):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    own, places, labels = words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(own) - len(p) + 1) if own[i:i + len(p)] == p]
        places += at
        if at:
            labels.add(label)
    return (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def simhash(text, size=3):
    own = SPACED.findall(lower(text))
    if not own:
        return 0
    shingles = [" ".join(own[i:i + size]) for i in range(max(1, len(own) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(prints, distance=3):
    """prints: {id: fingerprint}; the smallest id that each reaches."""
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def quality(text):
    text = text or ""
    own = SPACED.findall(text)
    n = len(own)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    first, covered = {}, set()
    for i in range(n - 7):
        first.setdefault(tuple(own[i:i + 8]), []).append(i)
    for at in first.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    return (n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
