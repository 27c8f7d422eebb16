"""Conversation structure repair: A* on the edit lattice of a conversation's turns.

A repaired conversation has the role initials `(s?(ua)+)?`.  Its lattice has a layer for each turn and four states: nothing
yet, after the system turn, after a user turn, after an assistant turn.  Keep, Rerole and Delete lead to the next layer,
Insert stays in one.  In every state only one of user and assistant can follow, so an audit (the edits' initials in order)
says all about a repair.  Suffix sums of mandatory deletions and of truncation charges that no edit avoids are an admissible
heuristic, and consistent: nodes leave the queue by (cost + heuristic, audit), so a node's first path is its cheapest, the
ASCII-least one of equally cheap ones.  (Of two equally cheap paths to a node none is a prefix of the other, as a loop costs.)

Turns come to a task as a stream, sorted by conversation, and are searched in cells of CELL turns: a cell is left in each
state by its best path, whose hash is carried on, and what all paths have in common is settled.  So a conversation of any
length takes the memory of a cell and of its audit.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .columns import narrow, read

CELL = 512
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads from each state, and the role that can follow with its state.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
LEGAL = {"su", "ua", "au"}
SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass
class Turn:
    role: str
    text: str
    must_go: bool
    truncated: bool


@dataclass
class Path:
    """The best way into a state: its cost, what of its audit isn't settled yet, and the hash of what it has written."""

    cost: int
    audit: str
    said: object = field(default_factory=hashlib.sha256)


def search(turns: list[Turn], entries: dict[int, Path], last: bool) -> dict[int, tuple[int, str, int]]:
    """cost, audit and entry state of the best path to each state behind the turns; if `last`, only to the best end."""
    n = len(turns)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if turns[i].must_go else TRUNCATED if turns[i].truncated else 0)
    queue = [(p.cost + rest[0], p.audit, 0, state, p.cost, state) for state, p in entries.items()]
    heapq.heapify(queue)
    closed: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str, int]] = {}
    while queue:
        _, audit, i, state, cost, origin = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n:
            if last and state in (NOTHING, ASSISTANT):
                return {state: (cost, audit, origin)}
            out[state] = (cost, audit, origin)
            if not last and len(out) == 4:
                break
        follows = NEXT[state][0]
        if i < n or last:  # behind a cell's last turn, the next cell inserts
            heapq.heappush(queue, (cost + INSERT + rest[i], audit + "I", i, follows, cost + INSERT, origin))
        if i < n:
            turn = turns[i]
            steps = [("D", state, DELETE)]
            if not turn.must_go:
                charge = TRUNCATED if turn.truncated else 0
                steps.append(("R", follows, REROLE + charge))
                to = KEPT.get((state, turn.role[:1]))
                if to is not None:
                    steps.append(("K", to, charge))
            for letter, to, price in steps:
                if (i + 1, to) not in closed:
                    heapq.heappush(queue, (cost + price + rest[i + 1], audit + letter, i + 1, to, cost + price, origin))
    return out


def replay(turns: list[Turn], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """role, text of the repaired turns that an audit makes of the turns, from a state on."""
    at = 0
    for letter in audit:
        follows, role = NEXT[state]
        if letter == "I":
            yield role, ""
            state = follows
            continue
        turn, at = turns[at], at + 1
        if letter == "K":
            yield turn.role, turn.text
            state = KEPT[state, turn.role[:1]]
        elif letter == "R":
            yield role, turn.text
            state = follows


class Repair:
    """One conversation, turn by turn."""

    def __init__(self) -> None:
        self.turns: list[Turn] = []
        self.paths = {NOTHING: Path(0, "")}
        self.settled: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.initial: str | None = None
        self.first = self.newest = None
        self.distinct = 0

    def add(self, turn_number: int | None, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if len(self.turns) == CELL:
            self._advance(False)
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = role[:1]
        if turn_number is not None and turn_number != self.newest:
            self.distinct, self.newest = self.distinct + 1, turn_number
            self.first = turn_number if self.first is None else self.first
        self.turns.append(Turn(role, text, fault in ("blank", "duplicate"), fault == "truncated"))

    def _advance(self, last: bool) -> None:
        moved = {}
        for state, (cost, audit, origin) in search(self.turns, self.paths, last).items():
            before = self.paths[origin]
            said, empty = before.said.copy(), origin == NOTHING
            for role, text in replay(self.turns, audit[len(before.audit) :], origin):
                said.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            moved[state] = Path(cost, audit, said)
        common = os.path.commonprefix([p.audit for p in moved.values()])
        self.settled.append(common)
        for p in moved.values():
            p.audit = p.audit[len(common) :]
        self.turns, self.paths = [], moved

    def row(self) -> dict:
        self._advance(True)
        (best,) = self.paths.values()
        gaps = 0 if self.first is None else self.newest - self.first + 1 - self.distinct
        return {"gaps": gaps, **self.counts, "cost": best.cost, "audit": "".join(self.settled) + best.audit, "repaired_sha256": best.said.hexdigest()}


def faults(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, gone) with blank, again (role and text seen earlier) and cut (no end mark).

    A conversation's turns lie in one partition, so what follows by conversation needs no other shuffle.
    """
    again = F.row_number().over(W.Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    end = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    return turns.repartition("conv_id").select("*", again.alias("again"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))


def repair(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit and repaired_sha256 of each conversation.

    conversations: conv_id, turn (long), role, text; other columns are left out.  Turns are taken by number, nulls first,
    equal ones by role and text; nulls in role or text count as one space; a null conv_id is a conversation.  Repeated rows
    are duplicates.  gone: marks rows that count as missing, whose conversation gets a row all the same.  An empty table
    gives no rows, and a conversation without turns zeros, an empty audit and the hash of an empty text.
    """
    rows = conversations.withColumn("gone", F.lit(False) if gone is None else gone)
    rows = narrow(rows, conv_id="conv_id", turn="turn", role="role", text="text", gone="gone")
    blanked = {c: F.when(~F.col("gone"), F.coalesce(c, F.lit(" "))) for c in ("role", "text")}
    rows = rows.withColumns({**blanked, "turn": F.when(~F.col("gone"), F.col("turn").cast("long"))})
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again"]
    kind = T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType), *T.StructType.fromDDL(SCHEMA)])
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, current, done = None, None, []
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "blank", "again", "cut")]
            for conv_id, missing, *turn in zip(*values, strict=True):
                if current is None or conv_id != open_id:
                    if current is not None:
                        done.append({"conv_id": open_id, **current.row()})
                    open_id, current = conv_id, Repair()
                if not missing:
                    current.add(*turn)
            if done:
                yield _batch(done, batch.schema.field("conv_id").type, names)
                done = []
        if current is not None:
            yield _batch([{"conv_id": open_id, **current.row()}], batch.schema.field("conv_id").type, names)

    return faults(rows).sortWithinPartitions(*order).mapInArrow(run, kind)


def _batch(rows: list[dict], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32 of `conv_id:turn` (nulls: one space), modulo 20.

    0 marks the row as gone, 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes it a user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("kind") == 0).alias("gone"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all damaged conversations; see `repair` and `damage` for nulls, ties, repeats and empty tables."""
    return repair(damage(read(spark, sf_dir, "conversations")), gone=F.col("gone"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
