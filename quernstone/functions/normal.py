"""Compatibility normal forms (NFKC) as Column expressions.

Tables of the forms, of marks' classes and of pairs that join are made from Python's data by rule and become constant arrays of the
plan, looked up by blocks of code points.  A text is cut at its signs that could change, each with the sign before it; only those
pieces are taken apart, put in order and composed, and the rest of the text is left as it is.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
_CLASS_AT = 0xF0000  # a private sign for each class of marks stands before each sign taken apart
_LEFT, _MIDDLE, _RIGHT, _SYLLABLES = 0x1100, 0x1161, 0x11A7, 0xAC00
_MARK = "\x01"


def _points() -> list[int]:
    return [i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], dict[int, str], str]:
    """Of each sign that isn't its own form or is a mark: its parts, each behind its class; of each sign that joins: the signs
    that it joins with what comes of them; and a pattern of the signs that a text is cut at."""
    parts, joins, cut = {}, {}, set()
    for i in _points():
        c = chr(i)
        if not _SYLLABLES <= i < _SYLLABLES + 11_172:
            whole = unicodedata.normalize("NFKD", c)
            if whole != c or unicodedata.combining(c):
                parts[i] = "".join(chr(_CLASS_AT + unicodedata.combining(x)) + x for x in whole)
            two = unicodedata.decomposition(c).split()
            if len(two) == 2 and not two[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
                first, second = (chr(int(x, 16)) for x in two)
                joins[ord(second)] = joins.get(ord(second), "") + _MARK + first + c
        if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c or _MIDDLE <= i <= 0x11C2:
            cut.add(i)
    return parts, joins, _class(cut | set(joins))


def _ranges(points: set[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for i in sorted(points):
        if out and i == out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return out


def _class(points: set[int]) -> str:
    """A pattern of one of the signs.  A class of so many ranges is slow to deny, so
    the ranges between them that texts are full of (all below U+0300, and the longest) are denied first."""
    written = lambda ranges: "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
    taken = _ranges(points)
    free = [[a, b] for a, b in zip([0, *(r[1] + 1 for r in taken)], [*(r[0] - 1 for r in taken), 0x10FFFF], strict=True) if a <= b]
    longest = sorted((r for r in free if r[0] >= 0x300), key=lambda r: r[0] - r[1])[:16]
    low = sorted((r for r in free if r[0] < 0x300), key=lambda r: r[0] - r[1])
    first = "".join(f"(?!{written([r])})" for r in [*low[:3], *longest[:3]])  # a range alone is quick, a class tries its ranges from the last
    common = written([*low, *longest])
    return f"(?:{first}(?!{common}){written(taken)})"


def _lookup(known: dict[int, str]):
    """A function of a code point's Column: its text, null where there is none."""
    numbers: dict[int, int] = {}
    for i in known:
        numbers.setdefault(i // BLOCK, len(numbers) + 1)
    index = [numbers.get(b, 0) for b in range(max(numbers) + 1)]
    texts: list[str | None] = [None] * (BLOCK * len(numbers))
    for i, text in known.items():
        texts[(numbers[i // BLOCK] - 1) * BLOCK + i % BLOCK] = text
    blocks = F.from_json(F.lit(json.dumps(index)), "array<int>")
    entries = F.from_json(F.lit(json.dumps(texts, ensure_ascii=False)), "array<string>")

    def find(point: Column) -> Column:
        block = F.get(blocks, F.floor(point / BLOCK).cast("int"))
        return F.when(block > 0, F.get(entries, (block - 1) * BLOCK + point % BLOCK))

    return find


def _sign(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def _composed(piece: Column) -> Column:
    """The normal form of a short text."""
    parts, joins, _ = _tables()
    apart, partner = _lookup(parts), _lookup(joins)
    signs = F.regexp_extract_all(piece, F.lit("(?s)."), 0)
    coded = F.array_join(F.transform(signs, lambda c: F.coalesce(apart(F.ascii(c)), F.concat(F.lit(chr(_CLASS_AT)), c))), "")
    pairs = F.transform(F.regexp_extract_all(coded, F.lit("(?s).."), 0), lambda x: F.struct((F.ascii(x) - _CLASS_AT).alias("rank"), F.substring(x, 2, 1).alias("sign")))
    # Marks lie in order of their classes between two signs that are none.
    run = lambda i: F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda p: p["rank"] == 0))
    ordered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(run(i).alias("run"), p["rank"].alias("rank"), i.alias("place"), p["sign"].alias("sign"))))

    def joined(first: Column, second: Column) -> Column:
        a, b = F.ascii(first), F.ascii(second)
        row = partner(b)
        at = F.instr(row, F.concat(F.lit(_MARK), first))
        pair = F.when(at > 0, F.substr(row, at + 2, F.lit(1)))
        syllable = F.when(a.between(_LEFT, _LEFT + 18) & b.between(_MIDDLE, _MIDDLE + 20), _sign(_SYLLABLES + ((a - _LEFT) * 21 + b - _MIDDLE) * 28))
        closed = F.when(a.between(_SYLLABLES, _SYLLABLES + 11_171) & ((a - _SYLLABLES) % 28 == 0) & b.between(_RIGHT + 1, _RIGHT + 27), _sign(a + b - _RIGHT))
        return F.when(first != "", F.coalesce(pair, syllable, closed))

    def step(state: Column, x: Column) -> Column:
        free = (state["marks"] == "") | (state["rank"] < x["rank"])
        one = F.when(free, joined(state["first"], x["sign"]))
        keep = lambda done, first, marks, rank: F.struct(done.alias("done"), first.alias("first"), marks.alias("marks"), rank.cast("int").alias("rank"))
        begun = keep(F.concat(state["done"], state["first"], state["marks"]), x["sign"], F.lit(""), F.lit(0))
        return F.when(one.isNotNull(), keep(state["done"], one, state["marks"], state["rank"])).when(x["rank"] == 0, begun).otherwise(keep(state["done"], state["first"], F.concat(state["marks"], x["sign"]), x["rank"]))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("first"), F.lit("").alias("marks"), F.lit(0).alias("rank"))
    return F.aggregate(ordered, start, step, lambda s: F.concat(s["done"], s["first"], s["marks"]))


def nfkc(c: Column) -> Column:
    """Compatibility forms, composed."""
    cut = _tables()[2]
    pattern = F.lit(f"(?s).?{cut}+")
    between, found = F.split(c, f"(?s).?{cut}+", -1), F.regexp_extract_all(c, pattern, 0)
    whole = F.array_join(F.transform(F.arrays_zip(between.alias("text"), F.transform(found, _composed).alias("form")), lambda x: F.concat(x["text"], F.coalesce(x["form"], F.lit("")))), "")
    return F.when(c.rlike(cut), whole).otherwise(c)
