"""Conversation structure repair: generalised LR parsing with weighted edits over the role grammar.

The grammar of roles is nothing, or an optional system turn and pairs of user and assistant. It is parsed from the last row to the
first, so that an edit is written before those of later rows and of two audits with one continuation the smaller stays smaller.

1. The LR automaton of the mirrored grammar is built from the productions below. A frontier is the graph-structured stack's tops:
   for each stack of states the least (cost, audit) that leads there. A row is kept, reroled or deleted, turns are inserted
   between rows; each edit shifts a role (or none), reductions follow, and equal stacks merge by the smaller (cost, audit).
2. Equal rows of a conversation are one row with a count from the first shuffle on. Rows are dealt by range of (conversation, turn,
   role, start of the text), so a conversation with a large share of all rows lies in many tasks.
3. A task cuts the rows of a conversation into fragments of bounded size. A conversation that lies in one fragment, with others
   before and after it in the task, is done there. For the others a fragment becomes a table from each stack before it to each
   stack behind it with the least (cost, audit); these tables compose, and the rows of texts are not needed for that. Of two
   edits of equal cost no audit is the beginning of the other (what is longer inserts, which costs), so composing is exact.
4. The hash of a conversation that lies in several fragments is a sequential digest: its repaired fragments pass one task as a
   stream, in order, one fragment in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The grammar of role initials, read from the right.
GRAMMAR = [("talk", ()), ("talk", ("pairs",)), ("talk", ("pairs", "s")), ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("a", "u"))]
#: Costs of edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
NAMES = {"u": "user", "a": "assistant"}
FRAGMENT_ROWS, FRAGMENT_BYTES = 4096, 8 << 20
BLANK = "\t\n\x0b\x0c\r "

Audit = tuple | None
Frontier = dict[tuple, tuple[int, Audit]]


class Automaton:
    """LR(0) states of GRAMMAR as sets of (production, place); the reductions of this grammar need no lookahead but the end."""

    def __init__(self, grammar: list[tuple[str, tuple]]):
        self.grammar, self.heads = grammar, {head for head, _ in grammar}
        self.begin = self.closure({(i, 0) for i, (head, _) in enumerate(grammar) if head == grammar[0][0]})
        self.shifts: dict[tuple, tuple | None] = {}

    def closure(self, items: set) -> frozenset:
        todo, out = list(items), set(items)
        while todo:
            i, at = todo.pop()
            body = self.grammar[i][1]
            for j, (head, _) in enumerate(self.grammar):
                if at < len(body) and body[at] == head and (j, 0) not in out:
                    out.add((j, 0))
                    todo.append((j, 0))
        return frozenset(out)

    def goto(self, state: frozenset, symbol: str) -> frozenset | None:
        moved = {(i, at + 1) for i, at in state if self.grammar[i][1][at : at + 1] == (symbol,)}
        return self.closure(moved) if moved else None

    def shift(self, stack: tuple, symbol: str) -> tuple | None:
        """The stack after a shift and the reductions that it completes, None where the symbol doesn't fit. A whole `talk` is reduced at the end only."""
        if (stack, symbol) not in self.shifts:
            new, pushed = self.goto(stack[-1], symbol), stack
            while new is not None:
                pushed = (*pushed, new)
                done = [i for i, at in new if at == len(self.grammar[i][1]) and self.grammar[i][0] != self.grammar[0][0]]
                if not done:
                    break
                head, body = self.grammar[done[0]]
                pushed = pushed[: len(pushed) - len(body)]
                new = self.goto(pushed[-1], head)
            self.shifts[stack, symbol] = None if new is None else pushed
        return self.shifts[stack, symbol]

    def accepts(self, stack: tuple) -> bool:
        """Whether the stack is a whole `talk` at the end of the input."""
        return any(at == len(self.grammar[i][1]) == len(stack) - 1 for i, at in stack[-1] if self.grammar[i][0] == self.grammar[0][0])

    def stacks(self) -> list[tuple]:
        """All stacks that inputs lead to: a few, as the grammar recurs on the left alone."""
        found = [(self.begin,)]
        for stack in found:
            found += [new for x in "sua" if (new := self.shift(stack, x)) and new not in found]
        return found


LR = Automaton(GRAMMAR)
STACKS = LR.stacks()
PLACE = {stack: i for i, stack in enumerate(STACKS)}
#: The role that begins what a stack has read: an assistant where the pair still wants its user.
WANTS = ["a" if LR.shift(stack, "u") else "u" for stack in STACKS]


def before(a: Audit, b: Audit) -> bool:
    """Whether audit a stands before b; an audit is a chain (letters, rest), None at its end."""
    i = j = 0
    while a is not b or i != j:
        if a is None or b is None:
            return a is None and b is not None
        n = min(len(a[0]) - i, len(b[0]) - j)
        x, y = a[0][i : i + n], b[0][j : j + n]
        if x != y:
            return x < y
        i, j = i + n, j + n
        if i == len(a[0]):
            a, i = a[1], 0
        if j == len(b[0]):
            b, j = b[1], 0
    return False


def merge(tops: Frontier, stack: tuple | None, cost: int, audit: Audit) -> bool:
    if stack is None:
        return False
    old = tops.get(stack)
    if old is None or cost < old[0] or (cost == old[0] and before(audit, old[1])):
        tops[stack] = (cost, audit)
        return True
    return False


def inserted(tops: Frontier) -> Frontier:
    """The frontier with all that inserted turns lead to."""
    todo = list(tops)
    while todo:
        stack = todo.pop()
        cost, audit = tops[stack]
        for x in "ua":
            if merge(tops, new := LR.shift(stack, x), cost + INSERT, ("I", audit)):
                todo.append(new)
    return tops


def edited(tops: Frontier, initial: str, must_go: bool, truncated: bool) -> Frontier:
    """The frontier before a row, from the one behind it."""
    out: Frontier = {}
    for stack, (cost, audit) in tops.items():
        merge(out, stack, cost + DELETE, ("D", audit))
        if not must_go:
            stays = cost + TRUNCATED * truncated
            if initial in ("s", "u", "a"):
                merge(out, LR.shift(stack, initial), stays, ("K", audit))
            for x in "ua":
                merge(out, LR.shift(stack, x), stays + REROLE, ("R", audit))
    return inserted(out)


def letters(audit: Audit) -> str:
    out = []
    while audit is not None:
        out.append(audit[0])
        audit = audit[1]
    return "".join(out)


class Row:
    """A row of a conversation and how often it stands there; `again` if its role and text were seen in an earlier turn."""

    __slots__ = ("role", "text", "n", "must_go", "truncated", "blank")

    def __init__(self, role: str, text: str, n: int, again: bool):
        self.role, self.text, self.n = role, text, n
        bare = text.rstrip(BLANK)
        self.blank = not bare
        self.must_go = self.blank or again
        self.truncated = not self.must_go and bare[-1] not in ".!?"


def parsed(rows: list[Row], entry: tuple) -> Frontier:
    """The frontier before the rows, from the stack behind them."""
    tops = inserted({entry: (0, None)})
    for row in reversed(rows):
        for _ in range(row.n - 1):
            tops = edited(tops, "", True, False)
        tops = edited(tops, row.role[:1], row.must_go, row.truncated)
    return tops


def best(tops: Frontier) -> tuple[int, Audit, tuple]:
    """(cost, audit, stack) of the best whole conversation."""
    out: tuple | None = None
    for stack, (cost, audit) in tops.items():
        if LR.accepts(stack) and (out is None or cost < out[0] or (cost == out[0] and before(audit, out[1]))):
            out = (cost, audit, stack)
    return out


def repaired(rows: Iterable[tuple[str, str, int]], audit: str, wants: str) -> list[str]:
    """The `role:text` lines that an audit leaves of (role, text, times) rows; `wants` is the role that comes first."""
    each = ((role, text) for role, text, n in rows for _ in range(n))
    out = []
    for letter in audit:
        role, text = next(each) if letter != "I" else ("", "")
        if letter == "D":
            continue
        out.append(f"{role if letter == 'K' else NAMES[wants]}:{text}")
        if not (letter == "K" and role[:1] == "s"):
            wants = "a" if wants == "u" else "u"
    return out


FRAGMENT = (
    "part int, seq int, whole boolean, first_turn long, last_turn long, n_turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string, moves array<struct<entry:int,exit:int,cost:bigint,audit:string>>, lines array<struct<role:string,text:string,n:bigint>>"
)
LEGAL = {"su", "ua", "au"}


def fragment(turns: list[int | None], rows: list[Row], whole: bool) -> dict:
    """Counts of a fragment, with the repair of a whole conversation or the moves between stacks of a part of one."""
    known = [t for t in turns if t is not None]
    initials = [r.role[:1] for r in rows]
    pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(r.n - 1 for r in rows)  # copies are never legal neighbours
    out = {
        "whole": whole, "first_turn": min(known, default=None), "last_turn": max(known, default=None), "n_turns": len(set(known)), "first_role": initials[0] if rows else None, "last_role": initials[-1] if rows else None,
        "blank": sum(r.n for r in rows if r.blank), "duplicate": sum(0 if r.blank else r.n - (not r.must_go) for r in rows), "truncated": sum(r.truncated for r in rows), "illegal": pairs,
        "cost": None, "audit": None, "repaired_sha256": None, "moves": None, "lines": None,
    }
    lines = [(r.role, "" if r.must_go else r.text, r.n) for r in rows]
    if whole:
        cost, audit, _ = best(parsed(rows, STACKS[0]))
        audit = letters(audit)
        return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(repaired(lines, audit, "u")).encode()).hexdigest()}
    moves = [{"entry": i, "exit": PLACE[stack], "cost": cost, "audit": letters(audit)} for i, entry in enumerate(STACKS) for stack, (cost, audit) in parsed(rows, entry).items()]
    return out | {"moves": moves, "lines": [dict(zip(("role", "text", "n"), line)) for line in lines]}


def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conversations to fragments, in order."""
    part = TaskContext.get().partitionId()
    conv, turns, rows, size, seq, cut, first = None, [], [], 0, 0, False, True
    names = ("conv_id", "turn", "role", "text", "n", "again")
    kind, out = None, []

    def close(whole: bool) -> None:
        nonlocal turns, rows, size, seq
        out.append({"conv_id": conv, "part": part, "seq": seq} | fragment(turns, rows, whole))
        turns, rows, size, seq = [], [], 0, seq + 1

    def flushed() -> pa.RecordBatch:
        made = {name: pa.array([r[name] for r in out], kind if name == "conv_id" else _TYPES[name]) for name in ("conv_id", *_TYPES)}
        out.clear()
        return pa.RecordBatch.from_pydict(made)

    begun = False
    for batch in batches:
        kind = batch.column("conv_id").type
        for c, turn, role, text, n, again in zip(*(batch.column(name).to_pylist() for name in names)):
            if begun and c != conv:
                close(not (first or cut))
                cut = first = False
            elif begun and (len(rows) >= FRAGMENT_ROWS or size >= FRAGMENT_BYTES):
                close(False)
                cut = True
            conv, begun = c, True
            if n:
                rows.append(Row(role, text, n, again))
                turns.append(turn)
                size += len(text)
            if len(out) >= 1000 or (out and out[-1]["lines"]):
                yield flushed()
    if begun:
        close(False)
        yield flushed()


_MOVE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_LINE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_PLAIN = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_TYPES = {name: _PLAIN.get(kind) or {"moves": _MOVE, "lines": _LINE}[name] for name, kind in (x.split(" ", 1) for x in FRAGMENT.split(", "))}

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def composed(table: pa.Table) -> dict:
    """One conversation from the moves of its fragments: RESULT, and of each fragment (part, seq, the role that comes first, audit)."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    tops: dict[int, tuple[int, Audit]] = {0: (0, None)}
    for row in reversed(rows):
        new: dict[int, tuple[int, Audit]] = {}
        for move in row["moves"]:
            if move["entry"] in tops:
                cost, audit = tops[move["entry"]]
                merge(new, move["exit"], cost + move["cost"], (move["audit"], audit, row["part"], row["seq"], move["exit"]))
        tops = new
    cost, audit, _ = best({STACKS[i]: top for i, top in tops.items()})
    steps, chain = [], audit
    while chain is not None:
        steps.append({"part": chain[2], "seq": chain[3], "wants": WANTS[chain[4]], "edits": chain[0]})
        chain = chain[1]
    known = [r for r in rows if r["n_turns"]]
    shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))  # a turn on both sides of an edge
    filled = [r for r in rows if r["first_role"] is not None]
    edges = sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(filled, filled[1:]))
    total = {name: sum(r[name] for r in rows) for name in ("blank", "duplicate", "truncated", "illegal")}
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - sum(r["n_turns"] for r in known) + shared if known else 0
    return {"gaps": gaps, **total, "illegal": total["illegal"] + edges, "cost": cost, "audit": letters(audit), "steps": steps}


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, RESULT and repaired_sha256 of each conversation of `turns` (conv_id, turn: a whole number, role, text, and n, how often the row stands; 0 only names the conversation).

    Rows go by turn, nulls first, then role and text. Null roles and texts are one space. A null conv_id is a conversation; repeated
    rows are duplicates; empty texts are blank; a role whose initial is none of s, u, a can't be kept. Conversations and texts
    of any length are repaired whole; further columns are not read; an empty table gives no rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n")
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))
    keyed = common.with_row_key(one, "conv_id", "role", "text")
    # of texts that come in several turns of a conversation the first turn, null before all numbers; equal rows of one turn are one row with a count
    at = F.struct("turn")
    firsts = keyed.where("n > 0").groupBy(*common.ROW_KEY).agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    marked = keyed.join(firsts, common.ROW_KEY, "left").withColumn("again", F.coalesce(at > F.col("first"), F.lit(False)))
    order = ["conv_id", "turn", "role"]
    dealt = marked.select("conv_id", "turn", "role", "text", "n", "again").repartitionByRange(*order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    made = common.durable(dealt.mapInArrow(fragments, f"conv_id {kind}, {FRAGMENT}"))

    # the first and last of a task and those of many rows: moves compose, then the texts follow the chosen edits
    open_parts = made.where("not whole")
    names = [x.split()[0] for x in RESULT.split(", ")]
    steps = "array<struct<part:int,seq:int,wants:string,edits:string>>"

    def compose(table: pa.Table) -> pa.Table:
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1)} | {k: pa.array([v], _STEP if k == "steps" else _PLAIN["string" if k == "audit" else "long"]) for k, v in composed(table.drop_columns(["conv_id"])).items()})

    matrices = open_parts.select("conv_id", "part", "seq", "first_turn", "last_turn", "n_turns", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal", "moves")
    joined = common.durable(matrices.groupBy("conv_id").applyInArrow(compose, f"conv_id {kind}, {RESULT}, steps {steps}"))

    def lines(batch: pa.RecordBatch) -> dict:
        out = []
        for rows, wants, audit in zip(*(batch.column(name).to_pylist() for name in ("lines", "wants", "edits"))):
            left = repaired([(r["role"], r["text"], r["n"]) for r in rows], audit, wants)
            out.append("\n".join(left) if left else None)
        return {name: batch.column(name) for name in ("conv_id", "part", "seq")} | {"lines": pa.array(out, pa.string())}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, some, begun, kind = None, None, False, False, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            kind = batch.column("conv_id").type
            for c, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
                if not begun or c != conv:
                    if begun:
                        done[0].append(conv), done[1].append(sha.hexdigest())
                    conv, sha, some, begun = c, hashlib.sha256(), False, True
                if text is not None:
                    sha.update((b"\n" if some else b"") + text.encode())
                    some = True
            if done[0]:
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array(done[0], kind), "repaired_sha256": done[1]})
        if begun:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], kind), "repaired_sha256": [sha.hexdigest()]})

    chosen = joined.select(F.explode("steps").alias("s")).select("s.*")
    texts = open_parts.select("conv_id", "part", "seq", "lines").join(chosen, ["part", "seq"])
    ordered = common.map_batches(texts, lines, f"conv_id {kind}, part int, seq int, lines string").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    hashes = ordered.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    several = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", *names, "repaired_sha256")
    gaps = F.when(F.col("n_turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).otherwise(0).alias("gaps")
    return made.where("whole").select("conv_id", gaps, *names[1:], "repaired_sha256").unionByName(several)


_STEP = pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("wants", pa.string()), ("edits", pa.string())]))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of `repair` after the damage that the contract plants by crc32 of `conv_id:turn`; a dropped row leaves the conversation's name."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind"))
    kind, gone = F.col("kind"), F.col("kind") == 0
    text = F.when(gone | (kind == 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).alias("n"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
