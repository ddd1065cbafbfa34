"""Operators on single texts against brute force, on the given tables and on awkward rows."""

import base64
import json
import random
import re
import time
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeflow.llm import collocations, decontaminate, language, licenses, quality_lines, queries, secret_scan
from changeflow.llm.common import letter_words

AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t\n"), (4, "a"), (4, "a"), (None, "token = abcdefgh1 and AKIA" + "Z9" * 8),
    (5, "é " * 40_000), (6, "PassWord: 'hunter2hunter2' api_key=short secret=\"" + "0af3" * 10 + '"\n'),
    (7, "Under the MIT license. Apache License, Version 2.0 cc-by-nc CC BY NC under the mit license"),
    (8, "x y z " * 30), (9, "line one here.\nline one here.\n| menu | home | about |\n*** !!! ***"), (10, "tokentoken=aaaaaaaaatoken:bbbbbbbbbb"),
    (11, "퟿  \x1c ſecret=abcdefghi toKen=abcdefghi"), (12, "0" * 31 + " " + "f" * 32 + "G" + "1" * 70),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    given_rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    return given_rows + [(None if k is None else k + 10**6, t) for k, t in AWKWARD]


@pytest.fixture(scope="module")
def frame(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3)


def by_text(rows, *names):
    return sorted((str(r["doc_id"]), *(str(r[n]) for n in names)) for r in rows)


def expected(documents, function):
    return sorted((str(k), *(str(v) for v in function(t))) for k, t in documents)


def test_tokens_inside_words():
    head, rest = "eyJhbGciOiJIUzI1NiJ9", ".eyJzdWIiOiIxIn0xyz.abcdefghijklmnopqrstuv"
    assert secret_scan.find_secrets(f"x={head}{rest} y".encode()) == [(2, 64, "jwt")]
    assert secret_scan.find_secrets(f"x{head}{rest}".encode()) == [(1, 63, "jwt")]
    assert not secret_scan.find_secrets(b"eyJ" * 200_000)


def web_token(header, payload="eyJzdWIiOiIxIn0xyz", signature="s" * 20):
    return base64.urlsafe_b64encode(json.dumps(header, ensure_ascii=False).encode()).decode().rstrip("=") + f".{payload}.{signature}"


@pytest.mark.parametrize("before", ["tok_", "-", "7", "a", "\\n", "%20", "eyJ", "eyJhbGciOiJ", "eyJunk_eyJ-", "x.y.", "eyJunkjunk.", "é"])
@pytest.mark.parametrize("header", [{"alg": "HS256"}, {"alg": "none", "kid": "é𝄞"}, {"typ": {"a": [1]}, "alg": "x"}])
def test_tokens_after_other_letters(before, header):
    token = web_token(header)
    text = f"see {before}{token} end"
    start = 4 + len(before)
    assert secret_scan.find_secrets(text.encode()) == [(start, start + len(token), "jwt")]
    assert secret_scan.redact(text, secret_scan.find_secrets(text.encode())) == f"see {before}[jwt] end"


def test_long_runs_of_token_starts():
    end = ".abcdefgh." + "s" * 20
    began = time.thread_time()
    assert not secret_scan.find_secrets(b"eyJ" * 200_000)
    assert not secret_scan.find_secrets(b"eyJ" * 200_000 + end.encode())
    assert not secret_scan.find_secrets(b"eyJhbGciOiJ." * 50_000)
    closed = "eyJ" * 200_000 + base64.urlsafe_b64encode(b'"alg":"x"}').decode().rstrip("=") + end
    assert not secret_scan.find_secrets(closed.encode())
    token = web_token({"alg": "HS256"})
    text = "eyJ" * 200_000 + token
    assert secret_scan.find_secrets(text.encode()) == [(600_000, len(text), "jwt")]
    assert time.thread_time() - began < 30


def test_openssh_keys():
    def part(raw):
        return len(raw).to_bytes(4, "big") + raw

    def block(cipher, extra=b"", keys=1):
        raw = b"openssh-key-v1\0" + part(cipher) + part(b"none") + part(b"") + keys.to_bytes(4, "big") + part(b"p" * 51) * keys
        body = base64.encodebytes(raw + part(b"k" * 136) + extra).decode()
        return f"-----BEGIN OPENSSH PRIVATE KEY-----\n{body}-----END OPENSSH PRIVATE KEY-----"

    def kinds(text):
        return [k for _, _, k in secret_scan.find_secrets(text.encode())]

    assert kinds(block(b"none")) == kinds(block(b"none", keys=2)) == ["private_key"]
    assert kinds(block(b"aes256-gcm@openssh.com", b"t" * 16)) == ["private_key"]
    assert kinds(block(b"none", b"x")) == kinds(block(b"none", b"t" * 16)) == kinds(block(b"none", keys=0)) == []
    assert kinds(block(b"none").replace("b3BlbnNzaC", "b3BlbnNzaD")) == []


def test_secrets(frame, documents):
    rows = secret_scan.scan_secrets(frame).collect()
    assert by_text(rows, "n_assign", "n_access", "n_hex", "base_sha256") == expected(documents, lambda t: brute.secrets(t)[0])
    assert by_text(rows, "spans") == expected(documents, lambda t: [brute.secrets(t)[1]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "api_key", "apikey", "=", ":", " ", "'", "abcdefgh", "AKIA", "Z" * 12, "é", "0" * 20, "f" * 13,
                                 "Password", "SECRET", "𝄞", "\n", "passwd", "ſ"]), max_size=14).map("".join))
def test_secrets_any(text):
    base = [s for s in secret_scan.find_secrets(text.encode()) if s[2] in secret_scan.BASE]
    assert ",".join(f"{k}:{a}:{b}" for a, b, k in base) == brute.secrets(text)[1]


def test_secret_checksums(spark):
    body = "".join(random.Random(1).choices(secret_scan.BASE62, k=30))
    good = "ghp_" + body + secret_scan.base62(zlib.crc32(body.encode()), 6)
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    der = base64.b64encode(b"\x30\x82\x01\x00" + b"\x01" * 256).decode()
    texts = [f"see {good}.", f"see {bad}.", f"{head}.abcdefghijk.{'s' * 20}", "eyJhbGciOiJ.abcdefghijk." + "s" * 20,
             f"-----BEGIN PRIVATE KEY-----\n{der}\n-----END PRIVATE KEY-----", f"-----BEGIN PRIVATE KEY-----\n{der[4:]}\n-----END PRIVATE KEY-----"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r for r in secret_scan.scan_secrets(df, redacted="clean").collect()}
    assert [found[i]["n_secrets"] for i in range(6)] == [1, 0, 1, 0, 1, 0]
    assert found[0]["clean"] == "see [github]." and found[1]["clean"] == texts[1]


def test_redaction_overlaps():
    text = "token=" + "a" * 40 + " end"
    assert secret_scan.redact(text, secret_scan.find_secrets(text.encode())) == "[assign] end"


def test_quality(frame, documents):
    rows = quality_lines.clean_lines(frame).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_text(rows, *names) == expected(documents, brute.quality)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_removes_lines_then_documents(spark):
    clean = "\n".join(f"This is sentence number {i} of plain{i} and quite clean{i} text." for i in range(9))
    mixed = clean + "\nHome | About | Contact | Help | More.\nWe use cookies on this site.\nno end\nbad*** more!!! worse$$$ end###."
    lost = clean.split("\n")[0] + "\n" + clean.split("\n")[1] + "\n" + "\n".join(f"entry {i} without an end" for i in range(9))
    df = spark.createDataFrame([(1, clean, 9), (2, mixed, 9), (3, lost, 9)], SCHEMA + ", n_chars long")
    found = {r["doc_id"]: r for r in quality_lines.clean_lines(df).collect()}
    assert [found[i]["kept"] for i in (1, 2, 3)] == [True, True, False]
    assert found[2]["clean_text"] == clean
    assert (found[2]["n_punctuation_lines"], found[2]["n_navigation_lines"], found[2]["n_boilerplate_lines"]) == (2, 1, 1)
    kept = {r["doc_id"]: r for r in quality_lines.accepted(df).collect()}
    assert set(kept) == {1, 2} and kept[2]["text"] == clean and kept[2]["n_chars"] == len(clean)


def test_quality_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_lines.clean_lines(docs).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["n_words"] >= 20]
    assert sum(good) >= 0.97 * len(good)


def test_licenses(frame, documents):
    rows = licenses.scan_licenses(frame).collect()
    assert by_text(rows, "n_words", "n_base", "first_word", "last_word", "base_labels") == expected(documents, brute.licenses)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_license_notice_with_changes(spark):
    bsd = next(t for label, t in licenses.NOTICES if label == "bsd").split()
    changed = " ".join(bsd[:6] + ["really"] + bsd[6:12] + bsd[13:])
    df = spark.createDataFrame([(1, "intro " * 50 + changed), (2, " ".join(bsd[::-1]))], SCHEMA)
    found = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert found[1]["labels"] == "bsd" and found[1]["score"] >= 0.6 and found[1]["n_base"] == 0
    assert found[2]["labels"] == ""


def test_similar_notices_are_told_apart(spark):
    notices = dict(licenses.NOTICES)
    cc = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License"
    changed = notices["lgpl"].replace("it and/or modify", "it or kindly modify")
    given = [(n, k) for k, n in notices.items()] + [
        ("word " * 40 + n + " noncommercial lesser", k) for k, n in notices.items()] + [
        (cc.format("Non-Commercial"), "cc-by-nc"), (cc.format("Share Alike"), "cc-by-sa"), (cc.format("NoDerivatives"), ""),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License", "cc-by"), (changed, "lgpl"),
        (notices["gpl"].replace("General", "Affero General"), ""),
        (notices["cc-by"] + ". " + notices["cc-by-sa"] + ". " + notices["gpl"], "cc-by,cc-by-sa,gpl"),
        (notices["isc"] + " " + notices["isc"], "isc")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], SCHEMA)
    found = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [found[i]["labels"] for i in range(len(given))] == [",".join(sorted(set(filter(None, (k + "," + found[i]["base_labels"]).split(","))))) for i, (_, k) in enumerate(given)]
    assert all(found[i]["score"] == 1 for i in range(len(notices)))


def test_alignment():
    number = [label for label, _ in licenses.PHRASES + licenses.NOTICES].index("bsd")
    bsd = licenses.plain_words(dict(licenses.NOTICES)["bsd"])
    assert licenses.aligned(number, tuple(["x", "in", *bsd, "met", "y"])) == (2, 2 + len(bsd), len(bsd))
    assert licenses.aligned(number, tuple(bsd[:5] + ["really"] + bsd[6:])) == (0, len(bsd), len(bsd) - 1)
    assert licenses.aligned(number, tuple([bsd[0], "x", *bsd])) == (2, 2 + len(bsd), len(bsd))
    assert licenses.aligned(number, tuple(bsd[::-1])) is None


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    return rows + [(900, "x y z x y"), (901, None), (902, ""), (None, "menu home"), (903, "q"), (900, "x y z x y"), (904, "Under THE mit")]


@pytest.mark.parametrize("full", [False, True])
def test_benchmark(spark, frame, documents, items, full, monkeypatch):
    if full:
        # A bitmap with all bits set lets every place into the join, as a very large benchmark would; words decide.
        monkeypatch.setattr(decontaminate, "bitmap_of", lambda keys: np.full(1 << (collocations.BITMAP - 3), 255, np.uint8))
        documents = [d for d in documents if not d[1] or len(d[1]) < 3000][:40]
        frame = spark.createDataFrame(documents, SCHEMA)
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_benchmark(frame, table).collect()
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    short = [(k, t) for k, t in documents if not t or len(t) < 40_000]
    kept = [r for r in rows if not r["text"] or len(r["text"]) < 40_000]
    assert by_text(kept, *names) == expected(short, lambda t: brute.benchmark(t, items))
    assert (full or any(r["contaminated"] for r in rows)) and len(rows) == len(documents)


def test_windows_are_distinct_and_have_their_items(spark):
    rows = [(i % 4, "the same words in all of these items are here " + "x y " * (i % 4)) for i in range(40)] + [(None, "one two"), (9, None), (8, " , ")]
    found = {r["window"]: (r["size"], r["items"]) for r in decontaminate.windows_of(
        spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", 10).collect()}
    assert found["the same words in all of these items are here"] == (10, ["0", "1", "2", "3"]) and found["one two"] == (2, [""])
    assert found["same words in all of these items are here x"] == (10, ["1", "2", "3"]) and len(found) == 8


def test_passes_do_not_grow_with_the_benchmark(spark, documents, items):
    """However many items there are, the result joins the documents once, and its plan has one Python stage."""
    table = spark.createDataFrame(items * 3 + [(10**6 + i, f"made up number {i} and more words to fill the window up") for i in range(3000)],
                                  "item_id long, text string")
    frame = spark.createDataFrame(documents, SCHEMA)
    plan = decontaminate.find_benchmark(frame, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,é\n1"), max_size=60), max_size=5), st.integers(1, 30), st.integers(0, 4))
def test_sections_of_long_texts(given_texts, size, margin):
    before = decontaminate.SECTION
    decontaminate.SECTION = size
    try:
        found, grams = [], []
        for part in decontaminate.parts([t.encode() for t in given_texts], margin + 2):
            words = part.words
            spelled = [words.data[a:b] for a, b in zip(words.starts, words.ends)]
            found += [(int(n), int(p), w) for n, p, w, own in zip(part.text, part.place, spelled, part.own) if own]
            firsts, _ = decontaminate.shingles(words, 3)
            grams += [(int(part.text[i]), int(part.place[i]), *spelled[i:i + 3]) for i in firsts if part.own[i]]
    finally:
        decontaminate.SECTION = before
    plain = [letter_words(t.encode()) for t in given_texts]
    assert sorted(found) == [(n, p, w) for n, own in enumerate(plain) for p, w in enumerate(own)]
    assert sorted(grams) == [(n, p, *own[p:p + 3]) for n, own in enumerate(plain) for p in range(len(own) - 2)]


def test_a_hot_prefix_and_many_copies(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, item) for i in range(300)] + [(1000 + i, f"{item[:40]} {i} " * 30) for i in range(50)] + [(5000, "kappa lambda " + item + " alpha")]
    found = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.find_benchmark(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item), (2, item + " mu")], "item_id long, text string")).collect()}
    assert {found[i] for i in range(300)} == {(11, 2)} and found[5000] == (11, 2)
    assert {found[1000 + i] for i in range(50)} == {(0, 0)}


def test_empty_benchmark(spark, frame, documents):
    rows = decontaminate.find_benchmark(frame, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(rows) == len(documents) and not any(r["contaminated"] for r in rows)


def contains_parse(text, sample):
    """Phrases of one piece by substring search."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


@settings(max_examples=100, deadline=None)
@given(st.text("abcd é", min_size=1, max_size=60), st.text("abcd é", min_size=1, max_size=300))
def test_cross_parsing_is_longest_match(sample, text):
    model = (("one", language.normal(sample) or "z"),)
    whole = " ".join(("".join(c if c.isalpha() else " " for c in text)).split(" "))
    lengths, scores = language.parse_counts([text.encode()], model)
    flat = re.sub(" +", " ", whole).lstrip()
    if not flat.strip():
        assert lengths[0] == 0
        return
    pieces = [flat[i:i + language.PIECE] for i in range(0, len(flat), language.PIECE)]
    wanted = sum(contains_parse(p, model[0][1]) for p in pieces)
    assert lengths[0] == len(flat)
    assert scores[0, 0] == pytest.approx(wanted * 10 / len(flat))


def test_languages_of_many_letters(spark):
    draw = random.Random(5)
    han = [chr(0x4E00 + i) for i in range(700)]
    words = {"zh": ["".join(draw.choices(han, k=2)) for _ in range(900)], "ja": ["".join(draw.choices(han, k=3)) for _ in range(900)],
             "ka": ["".join(draw.choices([chr(0x10D0 + i) for i in range(33)], k=5)) for _ in range(40)],
             "hy": ["".join(draw.choices([chr(0x561 + i) for i in range(38)], k=5)) for _ in range(40)]}
    samples = {k: " ".join(draw.choices(w, k=9000 if k in ("zh", "ja") else 60)) for k, w in words.items()}
    texts = {k: " ".join(draw.choices(w, k=50)) for k, w in words.items()}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], SCHEMA)
    rows = sorted(language.predict(df, samples).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in rows] == list(texts)
    model = tuple(sorted(samples.items()))
    _, scores = language.parse_counts([t.encode() for t in texts.values()], model)
    for i, t in enumerate(texts.values()):
        for j, (_, sample) in enumerate(model):
            wanted = sum(contains_parse(t[a:a + language.PIECE], sample) for a in range(0, len(t), language.PIECE))
            assert scores[i, j] == pytest.approx(wanted * np.log2(max(language.SMALL_SAMPLE, len(sample))) / len(t))


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op3(spark, sf_dir).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    test = [r for r in rows if r["held_out"] and r["lang"] and len(r["text"]) > 40]
    assert len(rows) == docs.count()
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.98 * len(test)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_language_edges(spark, frame):
    rows = {r["doc_id"]: r for r in language.predict(frame.filter("doc_id > 1000000"), {"x": "é a b", "y": "zz"}).collect()}
    assert [rows[10**6 + i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert rows[10**6 + 5]["lang_pred"] == "x"
    nothing = language.predict(frame, language.learn(frame.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_clashing_and_empty(spark, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    odd = "doc_id long, text string, n_words string, kept string, score string, items string, hit_words int, labels int, spans int, words int, k int, clean_text string, template string, at int"
    row = (1, "under the mit license token=abcdefghij", "a", "b", "c", "d", 1, 2, 3, 4, 5, "e", "f", 6)
    runs = [
        secret_scan.scan_secrets, quality_lines.clean_lines, licenses.scan_licenses, quality_lines.accepted,
        lambda d: decontaminate.find_benchmark(d, table), lambda d: language.predict(d, {"x": "under the"}),
    ]
    for run in runs:
        full, empty = run(spark.createDataFrame([row], odd)), run(spark.createDataFrame([], odd))
        assert len(full.columns) == len(set(full.columns))
        assert full.count() <= 1 and empty.count() == 0
