"""Conversation structure repair: the cheapest edits that make a conversation's roles fit a grammar, by generalised LR.

The grammar's LR(0) automaton is built from its rules. A parser reads rows with weighted edits and keeps all stacks at once
in a graph whose nodes share what lies below them. Stacks with equal tops are merged, and the smaller (cost, audit) stays;
this loses nothing, as each top has only one stack below it, and two audits of equal cost have as many letters other than
Insert, so neither begins the other and the smaller stays the smaller whatever follows.

Every part of up to ``PART_ROWS`` distinct rows is parsed on its own from each stack that can stand between two rows; the
costs from stack to stack are then chained over the parts of a conversation. So no conversation is parsed in one task.
Only the chosen edits, and the checksum of the repaired rows, which is sequential by its nature, pass through a conversation
in order, a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import prepared, stored

# s? (u a)+, or nothing: a pair stays open after the user's turn. Each list is one way to derive the name.
GRAMMAR = {"Talk": [[], ["Pairs"]], "Pairs": [["Open", "a"]], "Open": [["u"], ["s", "u"], ["Pairs", "u"]]}
START = "Talk"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")

# Distinct rows of a part, a power of two.
PART_BITS = 9
# Characters of a text that order rows of the same turn and role; beyond them its digest does.
HEAD = 32
ORDER = ["turn", "role", "head", "digest"]

Weight = tuple[int, str]


class Node:
    """A stack top, the node below it, and the cheapest (cost, audit) of the whole stack."""

    __slots__ = ("state", "below", "weight")

    def __init__(self, state: int, below: Node | None, weight: Weight):
        self.state, self.below, self.weight = state, below, weight

    def stack(self) -> tuple[int, ...]:
        return (self.below.stack() if self.below else ()) + (self.state,)


Tops = dict[int, Node]


def merge(tops: Tops, node: Node) -> bool:
    """Add a top; of equal ones the smaller (cost, audit) stays. True if ``node`` is new or smaller."""
    known = tops.get(node.state)
    if known is not None and known.weight <= node.weight:
        return False
    tops[node.state] = node
    return True


class Automaton:
    """LR(0) states of a role grammar: where a symbol leads, which rules end, and which stacks stand between rows."""

    def __init__(self, grammar: dict[str, list[list[str]]] = GRAMMAR, start: str = START):
        self.grammar, self.start = grammar, start
        self.terminals = sorted({s for ways in grammar.values() for way in ways for s in way} - set(grammar))
        self.states = [self._closed({(start, i, 0) for i in range(len(grammar[start]))})]
        self.goto, self.ends = [], []
        for state in self.states:
            moves: dict[str, set] = {}
            for name, way, dot in state:
                for symbol in grammar[name][way][dot:dot + 1]:
                    moves.setdefault(symbol, set()).add((name, way, dot + 1))
            self.goto.append({})
            for symbol, kernel in sorted(moves.items()):
                target = self._closed(kernel)
                if target not in self.states:
                    self.states.append(target)
                self.goto[-1][symbol] = self.states.index(target)
            self.ends.append(sorted(
                (n, len(grammar[n][w])) for n, w, d in state if d == len(grammar[n][w]) and n != start))
        self.accepting = {i for i, state in enumerate(self.states)
                          if any(n == start and d == len(grammar[n][w]) for n, w, d in state)}
        self._settle()

    def _closed(self, items: set) -> frozenset:
        found, todo = set(items), list(items)
        while todo:
            name, way, dot = todo.pop()
            for symbol in self.grammar[name][way][dot:dot + 1]:
                for new in [(symbol, i, 0) for i in range(len(self.grammar.get(symbol, ())))]:
                    if new not in found:
                        found.add(new)
                        todo.append(new)
        return frozenset(found)

    def _settle(self) -> None:
        """All stacks that can stand between two rows, the move of each symbol, and the role that an edit can give."""
        self.stacks, self.moves, self.next_role = [(0,)], [], []
        for stack in self.stacks:
            moves = {}
            for symbol in self.terminals:
                tops = self.read({stack[-1]: self.node(stack)}, symbol, 0, "")
                for new in (n.stack() for n in tops.values()):
                    if new not in self.stacks:
                        self.stacks.append(new)
                    moves[symbol] = self.stacks.index(new)
            roles = [symbol for symbol in ROLES if symbol in moves]
            if len({s[-1] for s in self.stacks}) < len(self.stacks) or len(roles) > 1:
                raise ValueError("a stack top of the grammar must tell what is below it and which role may follow")
            self.moves.append(moves)
            self.next_role.append(ROLES[roles[0]] if roles else None)

    @staticmethod
    def node(stack: tuple[int, ...], weight: Weight = (0, "")) -> Node:
        node = None
        for state in stack:
            node = Node(state, node, weight)
        return node

    def read(self, tops: Tops, symbol: str, cost: int, letter: str) -> Tops:
        """The tops after every stack that allows it has read ``symbol`` and reduced the rules that end."""
        after: Tops = {}
        for node in tops.values():
            target = self.goto[node.state].get(symbol)
            if target is not None:
                self._reduce(after, Node(target, node, (node.weight[0] + cost, node.weight[1] + letter)))
        return after

    def _reduce(self, after: Tops, node: Node) -> None:
        for name, length in self.ends[node.state]:
            lower = node
            for _ in range(length):
                lower = lower.below
            target = self.goto[lower.state].get(name)
            if target is not None:
                self._reduce(after, Node(target, lower, node.weight))
        if self.goto[node.state] or node.state in self.accepting:
            merge(after, node)

    def step(self, tops: Tops, initial: str, must_go: bool, truncated: bool, times: int = 1) -> Tops:
        """The tops after a row was kept, rerolled or deleted; ``times`` equal rows that must go are one step."""
        after = {n.state: Node(n.state, n.below, (n.weight[0] + DELETE * times, n.weight[1] + "D" * times))
                 for n in tops.values()}
        if not must_go:
            extra = TRUNCATED if truncated else 0
            for symbol, cost, letter in [(initial, KEEP, "K"), *[(role, REROLE, "R") for role in ROLES]]:
                for node in self.read(tops, symbol, cost + extra, letter).values():
                    merge(after, node)
        return after

    def inserted(self, tops: Tops) -> Tops:
        """``tops`` and what inserted rows make of them, as long as that is new or cheaper."""
        tops, fresh = dict(tops), tops
        while fresh:
            found = [n for role in ROLES for n in self.read(fresh, role, INSERT, "I").values()]
            fresh = {n.state: n for n in found if merge(tops, n)}
            fresh = {s: n for s, n in fresh.items() if tops[s] is n}
        return tops


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


Ways = list[list[Weight | None]]


@lru_cache(maxsize=1 << 14)
def parse_part(rows: tuple[tuple[str, bool, bool, int], ...]) -> Ways:
    """The cheapest (cost, audit) from each settled stack to each, over rows of (initial, must go, truncated, times).

    Inserts after the last row aren't among them; they belong to the next part or to the ending.
    """
    table, out = automaton(), []
    for stack in table.stacks:
        tops = {stack[-1]: table.node(stack)}
        for row in rows:
            tops = table.step(table.inserted(tops), *row)
        ways = {n.stack(): n.weight for n in tops.values()}
        out.append([ways.get(end) for end in table.stacks])
    return out


@lru_cache(maxsize=1)
def endings() -> Ways:
    """From each settled stack, the cheapest inserts that end a conversation."""
    table, out = automaton(), []
    for stack in table.stacks:
        tops = table.inserted({stack[-1]: table.node(stack)})
        out.append([min((n.weight for s, n in tops.items() if s in table.accepting), default=None)])
    return out


class Chain:
    """The cheapest ways through the parts of a conversation. A way is a link (way before, audit, stack before the part)."""

    def __init__(self):
        self.ways: dict[int, tuple[int, tuple | None]] = {0: (0, None)}

    @staticmethod
    def _less(a: tuple, b: tuple) -> bool:
        """Whether way ``a`` has the smaller audit; both have as many parts, and mostly a common past."""
        left, right = [], []
        while a is not b:
            left.append(a[1])
            right.append(b[1])
            a, b = a[0], b[0]
        return "".join(reversed(left)) < "".join(reversed(right))

    def add(self, part: Ways) -> None:
        after: dict[int, tuple[int, tuple]] = {}
        for before, (cost, link) in self.ways.items():
            for stack, way in enumerate(part[before]):
                if way is not None:
                    new, old = (cost + way[0], (link, way[1], before)), after.get(stack)
                    if old is None or new[0] < old[0] or new[0] == old[0] and self._less(new[1], old[1]):
                        after[stack] = new
        self.ways = after

    def finish(self) -> tuple[int, list[tuple[int, str]]]:
        """The cost, and the stack before each part with the part's audit; the last one's has the ending's."""
        self.add(endings())
        cost, link = self.ways[0]
        link, ending = link[0], link[1]
        parts = []
        while link is not None:
            parts.append((link[2], link[1] + ending))
            link, ending = link[0], ""
        return cost, parts[::-1]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the checksum of conversation and turn; dropped ones have 0 copies.

    Nulls are one space, as are those of conversation and turn in the checksum.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _keyed(turns: DataFrame) -> DataFrame:
    """Rows with what orders and tells apart their texts. A row of 0 copies has only its conversation."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        copies.cast("long").alias("copies"))
    here = F.col("copies") > 0
    return rows.select("conv_id", F.when(here, F.col("turn")).alias("turn"), F.when(here, F.col("role")).alias("role"),
                       F.when(here, F.substring("text", 1, HEAD)).alias("head"),
                       F.when(here, F.unhex(F.sha2("text", 256))).alias("digest"), "text", "copies")


def placed_rows(turns: DataFrame) -> DataFrame:
    """Distinct rows without texts, numbered by ``place`` in the order of conversation, turn (nulls first), role and text."""
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    flags = _keyed(turns).withColumn("last", last).select(
        "conv_id", *ORDER, "copies", (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("truncated"))
    rows = flags.groupBy("conv_id", *ORDER).agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    return stored(rows.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).withColumn(
        "place", F.monotonically_increasing_id()), "repair-rows")


COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns"]
ENDS = ["first_turn", "last_turn", "first_initial", "last_initial"]


def parsed_parts(placed: DataFrame) -> DataFrame:
    """For each part: the order of its first row, its counts, its ends, and what it costs from stack to stack."""
    # A place is one row, so this join has no hot key, whatever repeats in the conversations.
    firsts = placed.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select(
        "place", F.lit(True).alias("first"))
    part = F.shiftright("place", PART_BITS).alias("part")
    entry = F.struct("place", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "truncated",
                     F.coalesce("first", F.lit(False)).alias("first"))
    begin = F.min(F.when(F.col("copies") > 0, F.struct("place", *ORDER)))
    parts = placed.join(firsts, "place", "left").groupBy("conv_id", part).agg(
        F.array_sort(F.collect_list(entry)).alias("rows"), begin.alias("begin"))
    kept = parts.select("conv_id", "part", *[F.col(f"begin.{c}").alias(c) for c in ORDER], "rows")
    kind = placed.schema["conv_id"].dataType.simpleString()
    ways = "array<array<struct<cost:bigint,audit:string>>>"
    schema = (f"conv_id {kind}, part long, turn long, role string, head string, digest binary, "
              + "".join(f"{c} long, " for c in COUNTS + ENDS[:2]) + "first_initial string, last_initial string, ways " + ways)
    arrow = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_part([r for r in rows if r["copies"]]) for rows in batch.column("rows").to_pylist()]
            counts = [pa.array([m[0][c] for m in made], pa.int64()) for c in COUNTS + ENDS[:2]]
            initials = [pa.array([m[0][c] for m in made], pa.string()) for c in ENDS[2:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ["conv_id", "part", *ORDER]] + counts + initials + [pa.array([m[1] for m in made], arrow)],
                names=["conv_id", "part", *ORDER, *COUNTS, *ENDS, "ways"])

    return prepared(kept).mapInArrow(run, schema)


def _part(rows: list[dict]) -> tuple[dict, list]:
    counts = dict.fromkeys(COUNTS, 0) | dict.fromkeys(ENDS)
    signs, before, turn = [], None, None
    for row in rows:
        copies, must_go = row["copies"], row["blank"] or not row["first"]
        counts["n_rows"] += copies
        if row["blank"]:
            counts["blank"] += copies
        else:
            counts["duplicate"] += copies - row["first"]
            counts["truncated"] += row["first"] and row["truncated"]
        # Neighbours with the same role never fit.
        counts["illegal"] += copies - 1 + (before is not None and before + row["initial"] not in LEGAL)
        before = row["initial"]
        if row["turn"] is not None:
            counts["n_turns"] += row["turn"] != turn
            turn = row["turn"]
            if counts["first_turn"] is None:
                counts["first_turn"] = turn
        if not must_go:
            signs.append((before, False, row["truncated"], 1))
            copies -= 1
        if copies:
            signs.append((before, True, False, copies))
    counts |= {"last_turn": turn, "last_initial": before, "first_initial": rows[0]["initial"] if rows else None}
    ways = [[w and {"cost": w[0], "audit": w[1]} for w in line] for line in parse_part(tuple(signs))] if rows else []
    return counts, ways


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _conversation(name, parts: list[dict], chain: Chain) -> list[tuple]:
    """A row for each part with its stack and audit, the first one with the totals."""
    totals = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    n_turns = sum(p["n_turns"] for p in parts)
    dated = [p for p in parts if p["first_turn"] is not None]
    for a, b in zip(parts, parts[1:], strict=False):
        totals["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    n_turns -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
    totals["gaps"] = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - n_turns if dated else 0
    totals["cost"], ways = chain.finish()
    rows = [(name, *[p[c] for c in ORDER], stack, audit) for p, (stack, audit) in zip(parts, ways, strict=True)]
    rows = rows or [(name, None, None, None, None, 0, "")]
    return [r + (tuple(totals[c] for c in TOTALS) if i == 0 else (None,) * len(TOTALS)) for i, r in enumerate(rows)]


def chosen_edits(parts: DataFrame) -> DataFrame:
    """(conv_id, turn, role, head, digest, stack, audit, totals): the edits of each part, and totals at the first one's."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *ORDER, "stack", "audit", *TOTALS]
    schema = (f"conv_id {kind}, turn long, role string, head string, digest binary, stack long, audit string, "
              + ", ".join(f"{c} long" for c in TOTALS))
    kinds = {"role": pa.string(), "head": pa.string(), "digest": pa.binary(), "audit": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a conversation only its counts by part and the chosen ways are held, no rows.
        current, held, chain, made = None, [], Chain(), []

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kinds.get(n, key_kind if n == "conv_id" else pa.int64()))
                 for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            key_kind = batch.column("conv_id").type
            for row in batch.to_pylist():
                if current != (row["conv_id"],):
                    if current is not None:
                        made += _conversation(current[0], held, chain)
                    current, held, chain = (row["conv_id"],), [], Chain()
                    if len(made) >= 1000:
                        yield table(made)
                        made = []
                ways = row.pop("ways")
                if row["n_rows"]:
                    chain.add([[w and (w["cost"], w["audit"]) for w in line] for line in ways])
                    held.append(row)
        if current is not None:
            yield table(made + _conversation(current[0], held, chain))

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return stored(prepared(ordered).mapInArrow(run, schema), "repair-edits")


class _Editor:
    """Applies the edits of one conversation to its rows as they come."""

    def __init__(self, name, totals: tuple):
        self.name, self.totals, self.position = name, totals, 0
        self.audit, self.at, self.stack = "", 0, 0

    def _out(self, role: str, text: str, edit: str) -> tuple:
        self.stack = automaton().moves[self.stack][role[:1]]
        self.position += 1
        return (self.name, self.position - 1, role, text, edit, None, *(None,) * len(TOTALS))

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._out(automaton().next_role[self.stack], "", "I")

    def part(self, stack: int, audit: str) -> Iterator[tuple]:
        """End the part before and begin another."""
        yield from self.inserts()
        self.stack, self.audit, self.at = stack, audit, 0
        yield (self.name, None, None, None, None, audit, *(None,) * len(TOTALS))

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(role if edit == "K" else automaton().next_role[self.stack], text, edit)

    def end(self) -> Iterator[tuple]:
        yield from self.inserts()
        yield (self.name, None, None, None, None, None, *self.totals)


def _edited(turns: DataFrame) -> DataFrame:
    """Repaired rows of each conversation in order, among them its audit by parts, and a last row with its totals."""
    edits = chosen_edits(parsed_parts(placed_rows(turns)))
    rows = _keyed(turns).filter("copies > 0")
    both = edits.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "position", "role", "text", "edit", "audit", *TOTALS]
    schema = (f"conv_id {kind}, position long, role string, text string, edit string, audit string, "
              + ", ".join(f"{c} long" for c in TOTALS))
    kinds = dict.fromkeys(("role", "text", "edit", "audit"), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, made, size = None, [], 0

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kinds.get(n, key_kind if n == "conv_id" else pa.int64()))
                 for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            key_kind = batch.column("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies", "stack", "audit", *TOTALS)]
            for name, is_row, role, text, copies, stack, audit, *totals in zip(*columns, strict=True):
                if is_row:
                    for _ in range(copies):
                        made += editor.row(role, text)
                    size += len(text)
                else:
                    # The first part of a conversation has its totals.
                    if totals[0] is not None:
                        if editor is not None:
                            made += editor.end()
                        editor = _Editor(name, tuple(totals))
                    made += editor.part(stack, audit)
                if len(made) >= 1000 or size >= 4 << 20:
                    yield table(made)
                    made, size = [], 0
        if editor is not None:
            yield table(made + list(editor.end()))

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "kind")
    return prepared(ordered).mapInArrow(run, schema)


def repair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the repaired rows of all conversations, those that were deleted left out.

    ``turns`` has conv_id, turn, role and text, and may have copies, which tells how many times a row counts. Other columns
    are left out. Rows are taken by turn, nulls first, then by role and text; a null role or text is one space, and rows
    without conv_id are one conversation. An empty table gives no rows.
    """
    return _edited(turns).filter("position IS NOT NULL").select("conv_id", "position", "role", "text", "edit")


def repair_report(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``turns``: its faults, the cost and letters of its edits, and a digest of the result.

    As ``repair_turns``; a conversation of which all rows have 0 copies has zeros, no edits and the digest of nothing.
    """
    names = ["conv_id", *TOTALS, "audit", "repaired_sha256"]
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + "".join(f"{c} long, " for c in TOTALS) + "audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audits = hashlib.sha256(), []
        for batch in batches:
            made = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text", "audit", *TOTALS)]
            for name, position, role, text, audit, *totals in zip(*columns, strict=True):
                if position is not None:
                    digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
                elif audit is not None:
                    audits.append(audit)
                else:
                    made.append((name, *totals, "".join(audits), digest.hexdigest()))
                    digest, audits = hashlib.sha256(), []
            if made:
                kinds = [batch.column("conv_id").type] + [pa.int64()] * len(TOTALS) + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    return _edited(turns).mapInArrow(run, schema)
