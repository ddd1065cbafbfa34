"""Operators over whole tables against brute force: chat, packing, near-duplicates, sharding, token files, the pipeline."""

import random
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from changeflow.llm import chat, decontaminate, packing, quality_lines, queries, secret_scan, sharding, simhash, tokens, wavelet
from changeflow.session import shared_dir

SCHEMA = "doc_id long, text string"
AWKWARD = [(1, None), (2, ""), (3, " \n "), (3, " \n "), (None, "two words"), (None, None), (5, "long text, " * 3000), (5, "other"),
           (6, "a\xa0\n b　c  d <|endoftext|> \r\n\t e"), (7, "x" * 5000)]


def load(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in load(spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def encode():
    made = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


# chat


def rendered(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string, position int, part int")
    return sorted(((r["conv_id"], r["n_turns"], r["part"], r["first_turn"], r["part_turns"], r["text"]) for r in chat.render_conversations(df).collect()), key=repr)


def turns(conv, texts, first=0):
    return [(conv, first + i, "user" if i % 2 == 0 else "assistant", t, "x", 1, 2) for i, t in enumerate(texts)]


def markup(texts):
    return "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\n{t or ''}<|im_end|>\n" for i, t in enumerate(texts))


def test_chat_against_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = duck.execute(queries.CHAT_SQL)
    names = [c[0] for c in found.description]
    mine = queries.op1(spark, sf_dir)
    assert sorted(map(tuple, mine.select(*names).collect())) == sorted(found.fetchall())


def test_chat_collapse(spark):
    long = [f"t{i}" for i in range(1300)]
    rows = turns(1, ["a", "b"]) + turns(2, ["a", "b", "c"]) + turns(3, ["a", "b", "c"]) + turns(4, ["a", "x"]) + turns(5, ["b"], 7)
    rows += turns(6, long) + turns(7, long[:600]) + turns(2, ["a"]) + turns(8, ["a", None, "z"]) + turns(9, ["a", ""]) + turns(None, ["q"])
    rows += [(10, None, None, "odd", "x", 1, 2), (10, None, "user", "odd", "x", 1, 2), (10, 0, "user", "odd", "x", 1, 2)]
    got = rendered(spark, rows)
    assert {(c, n) for c, n, *_ in got} == {(2, 3), (4, 2), (5, 1), (6, 1300), (8, 3), (None, 1), (10, 3)}
    whole = defaultdict(str)
    for c, _, part, first, size, text in sorted(got, key=lambda r: (r[0] or 0, r[2])):
        assert first == part * chat.BLOCK and size <= chat.BLOCK
        whole[c] += text
    assert whole[2] == markup(["a", "b", "c"]) and whole[6] == markup(long) and whole[8] == markup(["a", "", "z"])
    assert whole[10].startswith("<|im_start|>unknown\nodd") and rendered(spark, []) == []


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=12))
def test_chat_any(spark, conversations):
    rows = [t for i, c in enumerate(conversations) for t in turns(i, c)]
    wanted = set()
    for i, c in enumerate(conversations):
        longer = any(len(o) > len(c) and o[:len(c)] == c for o in conversations)
        if not longer and conversations.index(c) == i:
            wanted.add((i, markup(c)))
    assert {(r[0], r[5]) for r in rendered(spark, rows)} == wanted


# tokens and packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "\n", "\t", "\r", "é", "\xa0", " ", "'s", "don't", "12", "###", "\x1c", "<|endoftext|>", "日本", "𝄞", "x" * 70, "\x0b"]), max_size=20).map("".join))
def test_chunks_encode_as_whole(encode, text):
    assert tokens.encoder(tokens.default_tokenizer()).ids(text) == np.array(encode(text), "<u4").tobytes()


def test_bundles_and_other_characters(encode, documents, monkeypatch):
    monkeypatch.setattr(tokens, "BUNDLE", 3)
    own = tokens.Encoder(tokens.default_tokenizer())
    given = [t for _, t in documents[:20]] + ["a\x1eb", "a \x1e", "日本 b", "", "<|endoftext|> a", "b\x1c", "a b c d e f g"] * 2
    assert list(own.many(given)) == [np.array(encode(t), "<u4").tobytes() for t in given]
    assert not any(tokens.OTHER.search(c) for c in own.new)


@pytest.mark.parametrize("top", [2, 50257, 1 << 20])
def test_planes_across_strides(top):
    ids = np.random.default_rng(top).integers(0, top, 3 * wavelet.STRIDE + 17, dtype=np.uint32)
    matrix = wavelet.WaveletMatrix.build(ids)
    assert (matrix.all() == ids).all()
    for at in (0, wavelet.STRIDE - 1, wavelet.STRIDE, len(ids) - 1):
        assert matrix.access(at) == ids[at]
        places = np.flatnonzero(ids == ids[at])
        assert matrix.count(int(ids[at])) == len(places)
        assert matrix.select(int(ids[at]), len(places) - 1) == places[-1]


def test_encoder_forgets(encode, documents, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    own = tokens.Encoder(tokens.default_tokenizer())
    for _, text in documents[:20]:
        assert own.ids(text) == np.array(encode(text), "<u4").tobytes()


def check_packed(rows, documents, encode, limits=packing.Limits()):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append(r)
    wanted = sorted((str(k), brute.crc(encode(t) + [1])) for k, t in documents)
    ids = defaultdict(list)
    for k, t in documents:
        ids[k].append(encode(t) + [1])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for (key, size), own in pieces.items():
        same = [x for x in ids[key] if len(x) == size]
        spans = sorted((r["start"], r["length"], r["ids_crc32"]) for r in own)
        expected = [s for s in spans if any(brute.crc(x[s[0]:s[0] + s[1]]) == s[2] for x in same)]
        assert spans == expected and sum(s[1] for s in spans) == size * len(same)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= limits.tokens and len(own) <= limits.segments
        assert sum(r["n_loss"] for r in own) <= limits.loss and [r["segment"] for r in own] == list(range(len(own)))
    assert wanted is not None
    return len(sequences)


def test_packing(spark, sf_dir, documents, encode):
    rows = packing.pack_documents(load(spark, sf_dir), with_ids=True).collect()
    used = check_packed(rows, documents, encode)
    total = sum(r["length"] for r in rows)
    assert used * 2048 <= total * 1.01 + 2048
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows[:50])


def test_packing_awkward(spark, encode):
    df = spark.createDataFrame(AWKWARD, SCHEMA).withColumn("start", F.lit("clash")).repartition(2)
    check_packed(packing.pack_documents(df).collect(), AWKWARD, encode)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_pool_and_limits(spark, encode, monkeypatch):
    random.seed(4)
    documents = [(i, "word " * random.randint(0, 90)) for i in range(600)]
    limits = packing.Limits(tokens=128, segments=3, loss=100, gap=4)
    df = spark.createDataFrame(documents, SCHEMA).coalesce(1)
    monkeypatch.setattr(packing, "POOL", 64)
    check_packed(packing.pack_documents(df, limits=limits).collect(), documents, encode, limits)


def test_packing_examples(spark):
    rows = [(1, [5, 6, 7, 8], [False, False, True, True]), (2, None, None), (3, [], []), (4, [9] * 50, [True] * 50), (5, [1, 2, 3], [True]), (6, [4, 4], None)]
    df = spark.createDataFrame(rows, "example_id long, ids array<int>, loss array<boolean>").coalesce(1)
    limits = packing.Limits(tokens=16, segments=4, loss=8, gap=0)
    got = packing.pack_examples(df, limits=limits, with_ids=True).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["start"]):
        by[r["example_id"]] += r["ids"]
    assert dict(by) == {1: [5, 6, 7, 8], 4: [9] * 50, 5: [1, 2, 3], 6: [4, 4]}
    sums = defaultdict(int)
    for r in got:
        sums[r["sequence_id"]] += r["n_loss"]
    assert max(sums.values()) <= 8 and sum(sums.values()) == 53


# near-duplicates


def test_fingerprint(documents):
    for _, text in documents + AWKWARD:
        assert simhash.fingerprint(None if text is None else text.encode()) % 2**64 == brute.simhash(text)


def check_components(spark, documents):
    df = spark.createDataFrame(documents, SCHEMA).withColumn("fp", F.lit("clash"))
    rows = simhash.near_duplicates(df).collect()
    prints = {i: brute.simhash(t) for i, (k, t) in enumerate(documents)}
    groups = brute.component_ids(prints)
    least = {}
    for i, (k, _) in enumerate(documents):
        if k is not None:
            least[groups[i]] = min(k, least.get(groups[i], k))
    wanted = sorted((str(k), f"{prints[i]:016x}", str(least.get(groups[i]))) for i, (k, _) in enumerate(documents))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == wanted


def test_near_duplicates(spark, documents):
    check_components(spark, documents + AWKWARD)
    check_components(spark, [])


def test_one_of_each_component(spark):
    def words(seed):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(60))

    a, b, c, d = map(words, range(4))
    rows = [(7, t) for t in map(words, range(10, 30))]  # one key, unrelated texts
    rows += [(1, a), (2, a), (2, b), (3, b), (3, b), (None, c), (None, c + " "), (None, d), (9, d), (None, None), (None, " "), (4, None)]
    df = spark.createDataFrame([(k, t, i % 2) for i, (k, t) in enumerate(rows)], SCHEMA + ", n int").repartition(3)
    got = simhash.one_of_each(df)
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert got.columns == df.columns and len(kept) == 20 + 5
    groups = brute.component_ids({i: brute.simhash(t) for i, (_, t) in enumerate(rows)})
    assert len(set(groups.values())) == len(kept)
    assert {(k, t) for k, t in kept if t and k == 7} == set(rows[:20])
    assert [(k, t) for k, t in kept if k != 7 and t and t.strip() != c] == [(1, a), (2, b), (9, d)]
    assert [(k, t) for k, t in kept if not t or not t.strip()] == [(4, None)]
    assert sorted(simhash.one_of_each(df.repartition(5, "n")).collect(), key=repr) == sorted(got.collect(), key=repr)


def linked(spark, prints, distance=3):
    df = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp long")
    rows = simhash.components(simhash.links(df.distinct(), distance)).collect()
    mask = 2**64 - 1
    return {r["node"] & mask: r["root"] & mask for r in rows}


@pytest.mark.parametrize("direct", [1024, 4])
def test_links_of_dense_groups(spark, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    random.seed(9)
    centre = random.getrandbits(64)
    prints = {centre}
    for _ in range(250):
        p = random.choice(sorted(prints)) if random.random() < 0.5 else centre
        for b in random.sample(range(64), random.choice([1, 2, 3])):
            p ^= 1 << b
        prints.add(p)
    prints |= {random.getrandbits(64) for _ in range(200)} | {centre ^ 0b1111 << 40, centre ^ 0b11111 << 50}
    prints = sorted(prints)
    got = linked(spark, prints)
    groups = brute.component_ids({p: p for p in prints})
    ours = {p: got.get(p, p) for p in prints}
    assert len(set(groups.values())) == len(set(ours.values()))
    assert all((groups[a] == groups[b]) == (ours[a] == ours[b]) for a in prints[::7] for b in prints[::5])


def test_forest_by_neighbours():
    random.seed(2)
    fps = np.unique(np.array([random.getrandbits(12) << 20 | 7 for _ in range(900)], np.int64))
    a, b = simhash._forest_direct(fps, 3), simhash._forest_by_neighbours(fps, 3)
    assert (a == b).all()
    assert (simhash._forest_direct(fps, 1) == simhash._forest_by_neighbours(fps, 1)).all()


def test_long_chain(spark):
    steps = [0]
    for i in range(60):
        steps.append(steps[-1] ^ (0b111 << i))
    chain = sorted(set(steps))
    got = linked(spark, chain)
    groups = brute.component_ids({p: p for p in chain})
    assert len({got.get(p, p) for p in chain}) == len(set(groups.values()))


# sharding


def check_shards(rows, documents, shards=16):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in documents)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        homes[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], shards) and 0 <= r["shard"] < shards and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards(spark, sf_dir, documents):
    rows = queries.op8(spark, sf_dir).collect()
    check_shards(rows, documents)
    first = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == 3)
    assert [d for _, d in first] != sorted(d for _, d in first)


def test_shards_awkward(spark):
    df = spark.createDataFrame(AWKWARD * 3, SCHEMA).withColumn("shard", F.lit("clash"))
    check_shards(sharding.shard_records(df).collect(), AWKWARD * 3)
    assert sharding.shard_records(df.limit(0)).count() == 0


def test_many_buckets_and_hot_key(spark):
    documents = [(7 if i % 3 == 0 else i, "t" * 50) for i in range(3000)]
    df = spark.createDataFrame(documents, SCHEMA).withColumn("size", F.lit(51).cast("long"))
    rows = sharding.shuffle_to_shards(df, shards=4, bucket_bytes=1024).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 3000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    placed = df.select(sharding.shard_of(F.col("doc_id"), 4).alias("shard"), "size")
    assert sharding.buckets_of(placed, 1024, 10**6) == {s: -(-51 * len(v) // 1024) for s, v in slots.items()}
    assert sharding.buckets_of(placed, 10**9, 100) == {s: -(-len(v) // 100) for s, v in slots.items()}
    assert sharding.buckets_of(placed.limit(0), 1024, 10) == {}


def test_written_shards(spark, sf_dir, documents):
    path = shared_dir(spark, "test-shards")
    sharding.write_shards(load(spark, sf_dir), path)
    back = spark.read.parquet(path)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted(documents)


def test_records_come_from_written_shards(spark, monkeypatch):
    folders = []

    def folder(session, name):
        folders.append(shared_dir(session, name))
        return folders[-1]

    monkeypatch.setattr(sharding, "shared_dir", folder)
    documents = [(7 if i % 3 == 0 else i, f"text {i} " * 30 if i else "very long " * 20_000) for i in range(600)] + [(None, None)]
    df = spark.createDataFrame(documents, SCHEMA).withColumn("size", F.lit("own")).withColumn("slot", F.lit("clash"))
    rows = sharding.shard_records(df, shards=4)
    check_shards(rows.collect(), documents, 4)
    back = spark.read.parquet(folders[0])
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(documents, key=repr)
    assert back.columns == ["doc_id", "text", "size", "slot", "shard"] and back.first()["size"] == "own"
    assert all(folders[0] in f for f in rows.inputFiles())
    files = defaultdict(list)
    for r in back.select("_metadata.file_path", "_metadata.row_index", "slot").collect():
        files[r["file_path"]].append((r["row_index"], r["slot"]))
    assert all([s for _, s in sorted(v)] == sorted(s for _, s in v) for v in files.values())


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300), st.integers(0, 60))
def test_wavelet_matrix(values, token):
    ids = np.array(values, "<u4")
    matrix = wavelet.WaveletMatrix.build(ids)
    assert matrix.all().tolist() == values
    assert [matrix.access(i) for i in range(len(values))] == values
    at = [i for i, v in enumerate(values) if v == token]
    assert matrix.count(token) == len(at) and [matrix.select(token, i) for i in range(len(at))] == at
    a, b = len(values) // 3, len(values) // 2
    assert matrix.count(token, a, b) == values[a:b].count(token)


def test_wavelet_blocks():
    ids = np.random.default_rng(3).integers(0, 50257, 3 * wavelet.BLOCK + 77).astype("<u4")
    data = wavelet.write_shard(ids, pa.array([1, None]), [10, len(ids) - 10], {"part": 0, "shard": 0, "first": 0})
    matrix, keys, lengths, head = wavelet.read_shard(data)
    assert (matrix.all() == ids).all() and keys.to_pylist() == [1, None] and lengths.tolist() == [10, len(ids) - 10]
    for at in (0, 1, wavelet.BLOCK - 1, wavelet.BLOCK, 2 * wavelet.BLOCK + 5, len(ids) - 1):
        token = int(ids[at])
        which = int((ids[:at] == token).sum())
        assert matrix.access(at) == token and matrix.select(token, which) == at and matrix.count(token) == int((ids == token).sum())
    with pytest.raises(IndexError):
        matrix.select(int(ids[0]), len(ids))


def check_tokens(rows, documents, encode):
    at, wanted = 0, []
    for k, t in sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = encode(t) + [0]
        wanted.append((k, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == wanted


def test_token_files(spark, sf_dir, documents, encode):
    check_tokens(queries.op10(spark, sf_dir).collect(), documents, encode)


def test_token_files_awkward(spark, encode):
    rows = [(1, None), (2, ""), (None, "two words"), (5, "long text, " * 3000), (6, "a\xa0\n b"), (9, "x y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("k", F.lit(0)).repartition(3)
    check_tokens(wavelet.token_table(df).collect(), rows, encode)
    assert wavelet.token_table(df.limit(0)).count() == 0
    twice = wavelet.token_table(df.unionByName(df)).collect()
    assert len(twice) == 12 and sorted(r["start"] for r in twice)[0] == 0
    assert sum(r["n_tokens"] for r in twice) == max(r["start"] + r["n_tokens"] for r in twice)


def test_token_files_split(spark, encode):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)] + [(60, "very long " * 400)]
    folder = shared_dir(spark, "test-tokens")
    manifest = wavelet.write_token_files(spark.createDataFrame(rows, SCHEMA), folder, shard_tokens=100)
    assert manifest.count() > 5
    check_tokens(wavelet.read_token_files(folder, manifest, "doc_id", T.LongType()).collect(), rows, encode)


# pipeline


def test_pipeline(spark, sf_dir, encode):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rules = quality_lines.LineRules()
    texts = {}
    for k, r in docs.items():
        verdict = quality_lines.judge(r["text"].encode(), rules)
        if verdict[6]:
            assert not brute.quality(r["text"])[5]
            texts[k] = verdict[-1].decode()
    groups = brute.component_ids({k: brute.simhash(t) for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if groups[k] == k}
    texts = {k: t for k, t in texts.items() if not brute.benchmark(t, items)[4]}
    texts = {k: secret_scan.redact(t, secret_scan.find_secrets(t.encode())) for k, t in texts.items()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packed(rows, list(texts.items()), encode)
    assert {r["doc_id"] for r in rows} == set(texts) and 0 < len(texts) < len(docs)


def test_stages_on_awkward_tables(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, items string, contaminated string, spans string, fp string, redacted string"
    text = " ".join(f"word{i}" for i in range(30)) + "."
    rows = [(1, None), (2, ""), (None, text), (None, text), (3, text), (3, text), (4, text + " token=abcdefghijk."), (5, "z " * 30000)]
    full = spark.createDataFrame([(k, t, "en", "s", 0, *["own"] * 7) for k, t in rows], kind)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns, name
            assert {r["kept"] for r in docs.collect()} <= {"own"}
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_packed_pieces_have_their_ids(spark, sf_dir, encode):
    text = "a text of some words " * 500
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    ids = {k: [i for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == k for i in r["ids"]] for k in (1, 2)}
    assert ids == {1: encode(text) + [1], 2: [1]}


def test_contaminated_documents_go(spark, sf_dir):
    item = decontaminate and spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, "before " + item + " after", "en", "s", 1), (2, "nothing of it", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()] == [2]


def test_loss_limit_decides_a_placement(spark):
    """Two examples fit by tokens and segments, and only their loss-bearing ids keep them apart."""
    limits = packing.Limits(tokens=20, segments=8, loss=10, gap=0)
    rows = [("a", [1] * 9, [True] * 9), ("b", [2] * 9, [True] * 9), ("c", [3] * 9, [False] * 9)]
    df = spark.createDataFrame(rows, "example_id string, ids array<int>, loss array<boolean>").coalesce(1)
    placed = packing.pack_examples(df, limits=limits).collect()
    by_sequence = defaultdict(set)
    for r in placed:
        by_sequence[r["sequence_id"]].add(r["example_id"])
    assert sum(r["n_loss"] for r in placed) == 18
    assert all(sum(r["n_loss"] for r in placed if r["sequence_id"] == s) <= 10 for s in by_sequence)
    without = packing.pack_examples(df, limits=packing.Limits(tokens=20, segments=8, loss=20, gap=0)).collect()
    together = {r["example_id"] for r in without if r["sequence_id"] == next(x["sequence_id"] for x in without if x["example_id"] == "a")}
    assert "b" in together and not any({"a", "b"} <= names and len(names) == 2 for names in by_sequence.values())


def test_first_lines_are_prompts(spark, encode):
    text = "A first line of words\nand then the rest of it\nand more"
    rows = packing.pack_documents(spark.createDataFrame([(1, text), (2, "one line only")], SCHEMA).coalesce(1)).collect()
    loss = {r["doc_id"]: r["n_loss"] for r in rows}
    first = encode("A first line of words\n")
    assert loss[1] == len(encode(text)) + 1 - len(first) and loss[2] == len(encode("one line only"))


def test_waiting_rests_hold_their_own_ids_only():
    sums = np.arange(250_001)
    item = packing.Item("k", np.zeros(250_000, "<u4"), sums, 0, 250_000, 0, 250_000)
    rest = item.rest(249_000)
    assert rest.ids.base is None and len(rest.ids) == 1000 and len(rest.sums) == 1001
    assert (rest.base, rest.total, rest.start, rest.end, rest.loss(0, 1000)) == (249_000, 250_000, 0, 1000, 1000)


def test_one_bucket_is_one_task(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(100).alias("size"), F.lit("x").alias("t"))
    placed = sharding.shuffle_to_shards(rows, shards=3, bucket_bytes=2000, bucket_rows=1000).withColumn("task", F.spark_partition_id())
    tasks = placed.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards")).collect()
    assert len(tasks) >= 20 and max(r["n"] for r in tasks) <= 60 and {r["shards"] for r in tasks} == {1}


def test_rows_with_maps_are_told_apart(spark):
    rows = [(1, "one two three four", {"a": 1}), (1, "one two three four", {"a": 2}), (2, "something else entirely here", None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]
