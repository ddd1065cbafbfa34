"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changeflow.llm import collocations, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "lang string, text string, phrase string, n int, key string, size int"


def expected(rows, support=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in ((("und" if lang is None else lang), text) for lang, text in rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        dropped = {long[i:i + k] for long, a in kept.items() for k in range(2, len(long)) for i in range(len(long) - k + 1)
                   if 100 * a >= 80 * counts[long[i:i + k]]}
        rows_ = []
        for p, a in kept.items():
            if p not in dropped:
                cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(a, b, "x", 1, "y", 2) for a, b in rows], SCHEMA).repartition(parts)


def made_up(seed, n):
    chosen = random.Random(seed)
    words = ["Aa", "b", "c", "d\t", "é", "ß", " ", "x\x1cy", "\xa0", "e.", "f,g", "h\n", "😀", "i;", "aa"]
    weights = [9, 8, 7, 6, 5, 4, 3, 2, 2, 1, 1, 1, 1, 1, 3]
    return [(chosen.choice(["en", "en", "en", "fr", None]), " ".join(chosen.choices(words, weights, k=chosen.randrange(40)))) for _ in range(n)]


AWKWARD = [("en", None), ("en", ""), (None, None), ("xx", " .,\n "), ("yy", "one"), ("", "a b " * 40), ("fr", "long word " * 4000), ("zz", "w" * 9000)]


def test_given_table(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(duck.sql(queries.COLLOCATION_SQL).project(", ".join(COLUMNS)).fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    assert found(queries.op13(spark, sf_dir)) == want == expected(rows)


@pytest.mark.parametrize("parts", [1, 5, 20])
def test_awkward_rows(spark, parts):
    rows = made_up(1, 300) + AWKWARD * 2
    assert found(collocations.collocations(frame(spark, rows, parts))) == expected(rows)


def test_small_sections_top_and_support(spark, monkeypatch):
    for name, value in (("SECTION", 50), ("HELD_KEYS", 40), ("HELD_STRINGS", 10), ("BATCH", 7)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.sections, "__defaults__", (50,))
    rows = made_up(2, 200)
    got = found(collocations.collocations(frame(spark, rows), support=3, top=25, shards=2))
    assert got == expected(rows, 3, 25) and max(r[1] for r in got) == 25


def test_saturated_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "bitmap_of", lambda keys: np.full(1 << (collocations.BITMAP - 3), 255, np.uint8))
    rows = made_up(3, 100)
    assert found(collocations.collocations(frame(spark, rows), support=5)) == expected(rows, 5)


def test_empty(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, AWKWARD[:4])).collect() == []


def test_mining_misses_nothing(spark):
    """Every phrase that is frequent over all is in the union of what the shards find, and few others are."""
    rows = made_up(4, 400)
    docs = frame(spark, [(None, t) for _, t in rows], 8).selectExpr("0L AS lang_id", "text")
    words = sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t)) for _, t in rows)
    sizes = spark.createDataFrame([(0, words)], "lang_id long, n long")
    keys = {r["key"] for r in collocations.mine_shards(docs, sizes, 30, (2, 3, 4)).collect()}
    parts = [((t or "").encode().translate(collocations.PIECES), len((t or "").encode()), 0) for _, t in rows]
    whole = collocations.Words(parts)
    for _, _, all_keys in whole.phrases():
        some, n = np.unique(all_keys, return_counts=True)
        assert set(some[n >= 30].view(np.int64).tolist()) <= keys
        assert not keys & set(some[n < 3].view(np.int64).tolist())


texts = st.text(st.sampled_from("ab \t.\né"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.integers(1, 20))
def test_phrases_any(some, size):
    cut = [(part, own, 0) for t in some for part, own in collocations.sections(t.encode().translate(collocations.PIECES), size)]
    words = collocations.Words(cut)
    got = Counter()
    for length, firsts, keys in words.phrases():
        assert len(keys) == len(firsts)
        got.update(words.strings(firsts, length))
    want = Counter()
    for t in some:
        for piece in re.split(r"[.\n]", t):
            w = re.findall(r"[^ \t]+", piece)
            want.update(" ".join(w[i:i + k]).encode() for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert got == want


def plain_counts(rows):
    counts = Counter()
    for _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update(" ".join(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    return counts


def test_shards_count_everywhere(spark):
    """What shards find has its exact count over all of them, so that texts aren't counted again, and nothing rarer is left."""
    rows = made_up(5, 400)
    counts = plain_counts(rows)
    docs = frame(spark, [(None, t) for _, t in rows], 8).selectExpr("0L AS lang_id", "text")
    sizes = spark.createDataFrame([(0, sum(n for p, n in counts.items() if " " not in p))], "lang_id long, n long")
    single = spark.createDataFrame([(0, p) for p, n in counts.items() if n >= 30 and " " not in p], "lang_id long, phrase string")
    words = spark.sparkContext.broadcast(collocations.vocabulary_of(single))
    mined = collocations.mine_shards(docs, sizes, 30, (2, 3, 4), vocabulary=words)
    got = {r["phrase"]: (r["size"], r["f"]) for r in collocations.phrase_strings(mined, words).collect()}
    assert got == {p: (p.count(" ") + 1, n) for p, n in counts.items() if n >= 30 and " " in p}


def test_passes_over_texts(spark, monkeypatch):
    """Words, pairs and longer phrases are each counted once; no task sends strings of the phrases that all other tasks send too."""
    kind = type(spark.range(1))
    made, plain = [], kind.mapInArrow

    def spied(df, function, schema, *args):
        if "text" in df.columns:
            made.append(schema)
        return plain(df, function, schema, *args)

    monkeypatch.setattr(kind, "mapInArrow", spied)
    rows = made_up(6, 100)
    assert found(collocations.collocations(frame(spark, rows), support=5)) == expected(rows, 5)
    assert len(made) == 3 and ["phrase" in schema for schema in made] == [True, False, False]


def test_words_of_one_hash(spark):
    """Words that the hash can't tell apart are told apart by their bytes."""
    one, other = b"a", b"b"
    for _ in range(11):
        one, other = one + other, other + one
    known = collocations.Words([(b" ".join([one, other]), 2 * len(one) + 1, 0)])
    assert known.hashes[0] == known.hashes[1]
    rows = [("en", f"x {w.decode()} y {w.decode()}") for w, n in ((one, 4), (other, 7)) for _ in range(n)]
    assert found(collocations.collocations(frame(spark, rows), support=3)) == expected(rows, 3)


some_words = st.text(st.sampled_from("abé"), min_size=1, max_size=4).flatmap(
    lambda w: st.integers(1, 30).map(lambda n: (w * n).encode()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), some_words), max_size=12, unique=True),
       st.lists(st.tuples(st.integers(0, 2), some_words), min_size=1, max_size=12), st.booleans())
def test_vocabulary_any(entries, others, alike):
    with pytest.MonkeyPatch.context() as patch:
        if alike:
            patch.setattr(collocations.Vocabulary, "keys", staticmethod(lambda hashes, languages: np.zeros(len(hashes), np.uint64)))
        known = collocations.Vocabulary(np.array([g for g, _ in entries], np.int64), [w for _, w in entries])
        asked = entries + others
        ids = known.find(collocations.Words([(w, len(w), g) for g, w in asked]))
    assert ids.tolist() == [entries.index(x) + 1 if x in entries else 0 for x in asked]
    assert known.strings().to_pylist() == [w.decode() for _, w in entries]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1))
def test_unmixed(values):
    h = np.array(values, np.uint64)
    assert collocations.unmixed(collocations.mixed(h)).tolist() == values
