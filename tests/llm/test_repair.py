"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from tidewell.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract's columns of one conversation's (turn, role, text) rows, in order, by a search over the automaton of `(s?(ua)+)?`."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    # states: nothing yet, after s, after u, after a
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    behind = None
    for i in range(len(rows), -1, -1):
        now = {0: (0, ""), 3: (0, "")} if i == len(rows) else {}

        def offer(state, cost, letter, to, frm):
            if to in frm:
                now[state] = min(now.get(state, (10**9, "")), (cost + frm[to][0], letter + frm[to][1]))

        for state in range(4):
            if i < len(rows):
                offer(state, 3, "D", state, behind)
                if faults[i] not in ("blank", "duplicate"):
                    late = faults[i] == "truncated"
                    offer(state, late, "K", step.get((state, rows[i][1][:1])), behind)
                    for x in "ua":
                        offer(state, 2 + late, "R", step.get((state, x)), behind)
        for _ in range(4):  # chains of inserts: none of the best is longer
            for state in range(4):
                for x in "ua":
                    offer(state, 2, "I", step.get((state, x)), now)
        behind = now
    cost, audit = behind[0]
    lines, at, wants = [], 0, "user"
    for letter in audit:
        role, text = rows[at][1:] if letter != "I" else ("", "")
        at += letter != "I"
        if letter != "D":
            lines.append(f"{role if letter == 'K' else wants}:{text}")
            if not (letter == "K" and role[0] == "s"):
                wants = "assistant" if wants == "user" else "user"
    known = {t for t, _, _ in rows if t is not None}
    legal = {"su", "ua", "au"}
    return (
        max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in legal for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(table):
    """Damage as the contract has it, then `plain`."""
    out = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = out.setdefault(conv, [])
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {conv: plain(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, rows in out.items()}


def found(df):
    columns = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r.conv_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Hello there.", "What now?", "no end", "", " \n", "Yes!", "é ok. ", None, "long words " * 2000 + "."]
    rows = []
    for conv in range(250):
        for turn in range(rng.randrange(1, 9)):
            plausible = ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.05 else turn + 3 * (rng.random() < 0.1), plausible if rng.random() < 0.7 else rng.choice(roles), f"Turn {turn} of {conv}." if rng.random() < 0.6 else rng.choice(texts)))
    rows += [(None, 1, "user", "Of no conversation."), (None, 2, "assistant", "Nor this.")] + [(900, 4, "user", "again.")] * 4
    rows += [(901, t, ("system", "user", "assistant")[t % 3 if t < 3 else 1 + t % 2], f"Row {t} {'.' if t % 5 else ''}" if t % 7 else "same.") for t in range(700)]  # in several fragments and tasks
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_equals_the_search(spark, table, monkeypatch):
    monkeypatch.setattr(repair, "FRAGMENT_ROWS", 4096)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in table], SCHEMA + ", audit string, n int, part int").repartition(5)
    assert found(repair.repair(repair.damaged(docs))) == expected(table)


def test_the_query_on_a_table(spark, table, tmp_path):
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(repair.op11_conversation_repair(spark, str(tmp_path))) == expected(table)


def test_an_empty_table(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("rows", list(product(["user", "assistant", "system", "x"], ["Ends.", "open", ""], repeat=2))[:72])
def test_two_rows(rows):
    each = [(i, role, f"{text}{i}." if text == "Ends." else text) for i, (role, text) in enumerate(zip(rows[::2], rows[1::2]))]
    made = repair.fragment([0, 1], [repair.Row(r, t, 1, i == 1 and (r, t) == each[0][1:]) for i, r, t in each], True)
    want = plain(each)
    assert (made["blank"], made["duplicate"], made["truncated"], made["illegal"], made["cost"], made["audit"], made["repaired_sha256"]) == want[1:]


def test_fragments_compose(table):
    """Any cut into fragments gives the audit of the whole."""
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["One.", "two", "", f"Own {i}."])) for i in range(rng.randrange(1, 12))]
        made, seen, at = [], set(), 0
        marked = []
        for i, r, t in rows:
            marked.append(repair.Row(r, t, 1, (r, t) in seen))
            seen.add((r, t))
        while at < len(rows):
            n = rng.randrange(1, 5)
            made.append({"part": 0, "seq": at} | repair.fragment([r[0] for r in rows[at : at + n]], marked[at : at + n], False))
            at += n
        got = repair.composed(pa.Table.from_pylist(made))
        want = plain(rows)
        assert tuple(got[k] for k in "gaps blank duplicate truncated illegal cost audit".split()) == want[:-1]
        lines = []
        for part, step in zip(made, got["steps"]):
            lines += repair.repaired([(x["role"], x["text"], x["n"]) for x in part["lines"]], step["edits"], step["wants"])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[-1]
