"""Conversation repair against a plain search for the cheapest edits."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeflow.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
# Where the roles of the grammar lead: nothing yet, after s, after u, after a.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, roles given by the edits) over (initial, must go, truncated) rows, state by state."""
    def put(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way
            return True
        return False

    def inserted(ways):
        todo = list(ways)
        while todo:
            state = todo.pop()
            cost, audit, roles = ways[state]
            for role in "ua":
                if role in NEXT[state] and put(ways, NEXT[state][role], (cost + 2, audit + "I", [*roles, role])):
                    todo.append(NEXT[state][role])
        return ways

    ways = {0: (0, "", [])}
    for initial, must_go, truncated in rows:
        after = {}
        for state, (cost, audit, roles) in inserted(ways).items():
            put(after, state, (cost + 3, audit + "D", [*roles, None]))
            for role, price, letter in [] if must_go else [(initial, 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                if role in NEXT[state]:
                    put(after, NEXT[state][role], (cost + price + truncated, audit + letter, [*roles, role]))
        ways = after
    ends = inserted(ways)
    return min(ends[s] for s in (0, 3) if s in ends)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def report(original, rows):
    """All columns of the query, by conversation."""
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, signs, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            visible = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = ("blank" if not visible else "duplicate" if (role, text) in seen
                     else "truncated" if visible[-1] not in ".!?" else None)
            if fault:
                faults[fault] += 1
            seen.add((role, text))
            signs.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, roles = cheapest(signs)
        lines, at = [], 0
        for letter, role in zip(audit, roles, strict=True):
            if letter == "I":
                lines.append(f"{FULL[role]}:")
                continue
            if letter != "D":
                lines.append(f"{mine[at][1] if letter == 'K' else FULL[role]}:{mine[at][2]}")
            at += 1
        turns = [r[0] for r in mine if r[0] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(signs, signs[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def made_up(seed, n):
    chosen = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "a.b", "So!  ", "the same text at first, for thirty-two letters. one", "the same text at first, for thirty-two letters. two"]
    return [(chosen.choice([1, 2, 3, None]), chosen.choice([0, 1, 2, 3, 4, 5, 9, None]),
             chosen.choice(["user", "assistant", "system", "tool", "", None]), chosen.choice(texts)) for _ in range(n)]


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11(spark, sf_dir)) == report(rows, damage(rows))


@pytest.mark.parametrize("bits", [0, 2, 9])
def test_awkward_rows_in_parts(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "PART_BITS", bits)
    rows = made_up(3, 60) + [(7, 11, "user", "x.")] + [(8, t, ["user", "assistant"][t % 2], "é" * 3000 + str(t) + ".") for t in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", digest string, place int").repartition(3)
    assert found(repair.repair_report(repair.damaged(df))) == report(rows, damage(rows))
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(repair.repair_report(df)) == report(rows, whole)


def test_repaired_rows_fit_the_grammar(spark):
    rows = made_up(5, 80)
    by_conversation = {}
    for r in repair.repair_turns(spark.createDataFrame(rows, SCHEMA)).collect():
        by_conversation.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"], r["edit"]))
    assert by_conversation
    for some in by_conversation.values():
        some.sort()
        assert [p for p, *_ in some] == list(range(len(some)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _, _ in some))
        assert all(text == "" for _, _, text, edit in some if edit == "I")


def test_empty_table_and_dropped_conversation(spark):
    assert repair.repair_report(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = repair.repair_report(repair.damaged(spark.createDataFrame([(5, gone, "user", "x.")], SCHEMA))).first()
    assert tuple(row[c] for c in NAMES) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_many_equal_rows_are_one_step(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], SCHEMA)
    many = df.withColumn("copies", F.when(F.col("turn") == 0, 5000).otherwise(1))
    row = repair.repair_report(many).first()
    assert (row["duplicate"], row["illegal"], row["cost"], row["audit"]) == (4999, 4999, 3 * 4999, "K" + "D" * 4999 + "K")


signs = st.lists(st.tuples(st.sampled_from(["u", "a", "s", "x", ""]), st.booleans(), st.booleans()), max_size=14)


@settings(max_examples=300, deadline=None)
@given(signs, st.integers(1, 5))
def test_edits_any(rows, size):
    chain = repair.Chain()
    rows = [(i, gone, False if gone else late) for i, gone, late in rows]
    for at in range(0, len(rows), size):
        chain.add(repair.parse_part(tuple((*r, 1) for r in rows[at:at + size])))
    cost, parts = chain.finish()
    assert (cost, "".join(audit for _, audit in parts)) == cheapest(rows)[:2]


def test_grammars_whose_stacks_grow_are_refused():
    with pytest.raises((ValueError, RecursionError)):
        repair.Automaton({"Talk": [["u", "Talk", "a"], ["u", "a"]]}, "Talk")


def test_sql_says_the_same(sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    rows = duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    found_by_sql = duck.sql(f"SELECT {', '.join(NAMES)} FROM ({queries.REPAIR_SQL})").fetchall()
    assert sorted(found_by_sql, key=repr) == report(rows, damage(rows))
