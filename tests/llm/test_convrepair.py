import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from quernstone.llm import convrepair

HERE = "/root/testdata"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    """rows: (conv_id, turn, role, text); conversations with their rows after damage."""
    out = {}
    for conv_id, turn, role, text in rows:
        kept = out.setdefault(conv_id, [])
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv_id)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        kept += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def expected(rows):
    """The repair of one conversation by dynamic programming over whole audits, with nothing left out but worse ones."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state):
        """(cost, audit) from turn i on; inserts come at most twice in a row, as two turns make a pair."""
        found = []
        for n in range(3):
            to, said = state, ""
            for _ in range(n):
                to = "a" if to == "u" else "u"
                said += "I"
            if i == len(rows):
                if to in ("", "a"):
                    found.append((2 * n, said))
                continue
            cost, audit = best(i + 1, to)
            found.append((2 * n + 3 + cost, said + "D" + audit))
            if marks[i] in ("blank", "duplicate"):
                continue
            extra = marks[i] == "truncated"
            for role in "ua":
                if role in step[to]:
                    cost, audit = best(i + 1, step[to][role])
                    found.append((2 * n + 2 + extra + cost, said + "R" + audit))
            initial = rows[i][1][:1]
            if initial in step[to]:
                cost, audit = best(i + 1, step[to][initial])
                found.append((2 * n + extra + cost, said + "K" + audit))
        return min(found)

    for i in range(len(rows), -1, -20):
        for state in step:
            best(i, state)
    cost, audit = best(0, "")
    state, at, said = "", 0, []
    for letter in audit:
        follows = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[follows]
        if letter == "I":
            said.append(f"{name}:")
            state = follows
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "K":
            said.append(f"{role}:{text}")
            state = role[0]
        elif letter == "R":
            said.append(f"{name}:{text}")
            state = follows
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def rows_of(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op11_against_dynamic_programming(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{HERE}/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = convrepair.op11_conversation_repair(spark, f"{HERE}/{sf}")
    assert got.count() == len(rows_of(got))
    assert rows_of(got) == {c: expected(r) for c, r in damaged(rows).items()}


def odd_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for _ in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "User"])
            text = rng.choice([None, "", " \n", "Yes.", "No", "Why?", "é", "a.", "a. \t", "x" * rng.randrange(40), "Well! ", f"t{rng.random()}."])
            rows.append((c if c else None, rng.choice([None, rng.randrange(-3, most)]), role, text))
    return rows


@pytest.mark.parametrize("cell", [3, 512])
def test_odd_conversations(spark, monkeypatch, cell):
    """All roles and texts, null and equal turns, repeated rows; with small cells all paths cross many borders."""
    monkeypatch.setattr(convrepair, "CELL", cell)
    rows = odd_rows(cell, 60, 25)
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, gone int, again string")
    for partitions in (1, 5):
        got = rows_of(convrepair.repair(convrepair.damage(df.repartition(partitions)), gone=convrepair.F.col("gone")))
        assert got == {c: expected(r) for c, r in damaged(rows).items()}


def test_search_in_small_cells_is_the_same():
    rng = random.Random(8)
    for _ in range(300):
        turns = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "a.", "b", "c."])) for i in range(rng.randrange(14))]
        before, results = convrepair.CELL, set()
        try:
            for convrepair.CELL in (1, 2, 5, 512):
                r, seen = convrepair.Repair(), set()
                for t in turns:
                    body = t[2]
                    r.add(*t, not body, t[1:] in seen, bool(body) and body[-1] != ".")
                    seen.add(t[1:])
                results.add(tuple(r.row()[c] for c in COLUMNS))
        finally:
            convrepair.CELL = before
        ((*_, cost, audit, digest),) = results
        want = expected(turns)
        assert (cost, audit, digest) == want[-3:]


def test_a_long_conversation(spark):
    """Twenty thousand turns, many of them faulty, and one of 2 MB."""
    rng = random.Random(2)
    turns = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "", "c!"]) + f" {i}." * rng.randrange(2)) for i in range(20_000)]
    turns[5] = (7, 5, "user", "word " * 400_000 + ".")
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = rows_of(convrepair.repair(df))
    want = expected([t[1:] for t in turns])
    assert got == {7: want}


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert convrepair.repair(spark.createDataFrame([], schema)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    df = spark.createDataFrame([(gone, 0, "user", "a.")], schema)
    assert rows_of(convrepair.repair(convrepair.damage(df), gone=convrepair.F.col("gone"))) == {gone: nothing}
