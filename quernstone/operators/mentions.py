"""Mentions of many names in lines of text, by one automaton for all names.

The names are a trie in flat arrays: states are numbered, an edge is state * signs + sign, and edges lie in a sorted array.
A name counts as `\\bname\\b` does, in any case, so it can only begin at a border of words: every border of a batch of texts
enters the automaton at once and walks it sign by sign with the others.  What has no edge drops out, which most do after a sign or
two, so no failure edges are needed and the work doesn't grow with the number of names.  A state that ends a name is a hit
where the walk stands at a border again.

More names than an automaton takes are joined: a name is made of whole runs of word signs and of others, so its small form equals
that of as many runs of the text, next to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch_dir

#: Names of one automaton; more names are joined with what stands in the texts.
NAMES_PER_PASS = 50_000
SIGNS_AT_ONCE = 1 << 20
_CODES = 0x110000


@lru_cache(maxsize=1)
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is part of a word, and its small form if that is one code point too."""
    word, small = np.zeros(_CODES, bool), np.arange(_CODES, dtype=np.uint32)
    for i in range(_CODES):
        c = chr(i)
        word[i] = c.isalnum() or c == "_"
        low = c.lower()
        if low != c and len(low) == 1:
            small[i] = ord(low)
    return word, small


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Automaton:
    """sign: number of each code point's small form among those of the names, 0 for others; root: where each sign leads first
    (0: nowhere); edges, to: sorted edges and where they lead; last: of each state, the place of its names in owners (-1: no
    name ends there)."""

    sign: np.ndarray
    root: np.ndarray
    edges: np.ndarray
    to: np.ndarray
    last: np.ndarray
    starts: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Automaton:
        """Each name, and with `_` for `-`; owners are indices into names."""
        _, small = _signs()
        spelled = sorted({(tuple(small[codes(form)].tolist()), i) for i, name in enumerate(names) if name for form in (name, name.replace("-", "_"))})
        points = sorted({p for form, _ in spelled for p in form})
        number = {p: i + 1 for i, p in enumerate(points)}
        sign = np.zeros(_CODES, np.int32)
        sign[points] = np.arange(1, len(points) + 1)
        found: dict[int, int] = {}
        ends: dict[int, list[int]] = {}
        wide = len(points) + 1
        for form, owner in spelled:
            state = 0
            for p in form:
                state = found.setdefault(state * wide + number[p], len(found) + 1)
            ends.setdefault(state, []).append(owner)
        edges = np.array(sorted(found), np.int64)
        to = np.array([found[e] for e in edges.tolist()], np.int64)
        last = np.full(len(found) + 1, -1, np.int64)
        last[list(ends)] = np.arange(len(ends))
        root = np.zeros(wide, np.int64)
        firsts = edges < wide
        root[edges[firsts]] = to[firsts]
        return cls(sign[small], root, edges, to, last, np.cumsum([0, *map(len, ends.values())]), np.array([o for e in ends.values() for o in e], np.int64))

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hit begins in the code points of a text, and the name's index."""
        word, _ = _signs()
        n, none = len(text), np.zeros(0, np.int64)
        if not n or not len(self.edges):
            return none, none
        inside = word[text]
        border = np.empty(n + 1, bool)
        border[0], border[n] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=border[1:n])
        begin = np.flatnonzero(border[:n])
        state = self.root[self.sign[text[begin]]]
        begin, state = begin[state > 0], state[state > 0]
        at = begin + 1
        where, which = [], []
        while len(at):
            end = np.flatnonzero((self.last[state] >= 0) & border[at])
            if len(end):
                group = self.last[state[end]]
                counts = self.starts[group + 1] - self.starts[group]
                where.append(np.repeat(begin[end], counts))
                which.append(self.owners[np.repeat(self.starts[group], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)])
            inner = at < n
            begin, at, state = begin[inner], at[inner], state[inner]
            sign = self.sign[text[at]]
            begin, at, state, sign = (x[sign > 0] for x in (begin, at, state, sign))
            edge = state * len(self.root) + sign
            place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            there = self.edges[place] == edge
            begin, at, state = begin[there], at[there] + 1, self.to[place[there]]
        return (np.concatenate(where), np.concatenate(which)) if where else (none, none)


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Whole texts in runs of about SIGNS_AT_ONCE signs, with the index of the first."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > SIGNS_AT_ONCE:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def mentions(files: DataFrame, packages: DataFrame, names_per_pass: int = NAMES_PER_PASS) -> DataFrame:
    """path, line (from 1), package: lines that hold a package's name, or that with `_` for `-`, in any case and with a
    border of words on either side; a line counts once for a package.

    files: path, text (null: none); packages: package; null and empty names and those with a line's end find nothing.  A line ends at `\\n`.  Up to
    names_per_pass names go to the tasks as one automaton; more meet the texts by a join, so neither depends on their number.
    """
    names, known = _few(packages, names_per_pass)
    if known is not None:
        return _searched(files, files.sparkSession.sparkContext.broadcast(known))
    forms, kinds = _forms(names)
    numbered = files.select("path", "text", F.monotonically_increasing_id().alias("number"))
    rows = _windows(numbered, kinds, True).join(forms, "form")
    one = rows.where("not two").select("path", "line", "package")
    return one.unionByName(rows.where("two").select("number", "path", "line", "package").distinct().select("path", "line", "package"))


def line_counts(files: DataFrame, packages: DataFrame, names_per_pass: int = NAMES_PER_PASS) -> DataFrame:
    """package, n_lines: how many lines `mentions` finds for each name that it finds.

    With more than names_per_pass names, lines are counted by what stands in them before names are joined; only names with
    `-`, which a line may hold in two forms, are counted by rows.
    """
    names, known = _few(packages, names_per_pass)
    if known is not None:
        return _searched(files, files.sparkSession.sparkContext.broadcast(known)).groupBy("package").agg(F.count("*").alias("n_lines"))
    forms, kinds = _forms(names)
    once, twice = forms.where("not two"), forms.where("two")
    numbered = files.select("path", "text", F.monotonically_increasing_id().alias("number"))
    counted = _windows(numbered, kinds, False).groupBy("form").agg(F.sum("n").alias("n_lines"))
    found = once.join(counted, "form").select("package", "n_lines")
    if not twice.limit(1).count():
        return found
    rows = _windows(numbered, kinds, True).join(twice, "form").select("number", "path", "line", "package").distinct()
    return found.unionByName(rows.groupBy("package").agg(F.count("*").alias("n_lines")))


def _few(packages: DataFrame, most: int) -> tuple[DataFrame, list[str] | None]:
    """Different names that can be found, as a table, and as a list if there are at most `most`."""
    at = scratch_dir(packages.sparkSession, "names")
    packages.select("package").where((F.col("package") != "") & ~F.col("package").contains("\n")).distinct().write.parquet(at)
    names = packages.sparkSession.read.schema("package string").parquet(at)
    known = names.limit(most + 1).toArrow().column("package").to_pylist()
    return names, sorted(known) if len(known) <= most else None


def _parts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of word signs and of other signs begin, and the end of the last; and whether each is of word signs."""
    inside = _signs()[0][text]
    starts = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    return np.append(starts, len(text)), inside[starts]


def _forms(names: DataFrame) -> tuple[DataFrame, list[tuple[int, bool]]]:
    """form, package, two: small forms of each name (two: it has two different ones); and the kinds of forms that there are: of
    how many runs of word signs and others, and whether the first is of word signs.

    A name's ends are borders, so its runs are whole runs of the text, but at the ends of a line, where other signs have no border.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = _signs()[1]
        for batch in batches:
            rows = []
            for name in batch.column("package").to_pylist():
                spelled = {form: small[codes(form)] for form in (name, name.replace("-", "_"))}
                forms = {_text(x): _parts(x) for x in spelled.values()}
                rows += [(form, name, len(forms) > 1, len(starts) - 1, bool(word[0])) for form, (starts, word) in forms.items()]
            form, name, two, runs, word = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(name, pa.string()), pa.array(two, pa.bool_()), pa.array(runs, pa.int32()), pa.array(word, pa.bool_())], names=["form", "package", "two", "runs", "word"])

    at = scratch_dir(names.sparkSession, "names")
    names.mapInArrow(run, "form string, package string, two boolean, runs int, word boolean").write.parquet(at)
    forms = names.sparkSession.read.schema("form string, package string, two boolean, runs int, word boolean").parquet(at)
    return forms.select("form", "package", "two"), [(r.runs, r.word) for r in forms.select("runs", "word").distinct().collect()]


def _text(signs: np.ndarray) -> str:
    return signs.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _windows(files: DataFrame, kinds: list[tuple[int, bool]], rows: bool) -> DataFrame:
    """form and what has it: runs next to each other of the kinds, in small forms, once a line.  rows: number, path, line of each;
    else n, in how many lines of a batch it is."""
    kind = T.StructType([T.StructField("path", files.schema["path"].dataType), *T.StructType.fromDDL("number long, line int, form string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = _signs()[1]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for first, run_of in _runs(texts):
                whole = codes("\n".join(run_of))
                if not len(whole):
                    continue
                breaks = np.flatnonzero(whole == 10)
                low = _text(small[whole])
                starts, word = _parts(whole)
                count = len(word)
                at, forms = [], []
                for runs, begins in kinds:
                    i = np.arange(max(count - runs + 1, 0))
                    i = i[(word[i] == begins) & ((i > 0) | begins)]  # other signs at either end of a text have no border
                    last = i + runs - 1
                    i = i[word[last] | (last < count - 1)]
                    a, b = starts[i], starts[i + runs]
                    inner = np.searchsorted(breaks, a) == np.searchsorted(breaks, b)
                    a, b = a[inner], b[inner]
                    at.append(a)
                    forms += [low[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                at = np.concatenate(at)
                if not len(at):
                    continue
                coded = pa.array(forms, pa.string()).dictionary_encode()
                which = coded.indices.to_numpy().astype(np.int64)
                wide = len(coded.dictionary)
                line, which = np.divmod(np.unique(np.searchsorted(breaks, at) * wide + which), wide)
                if not rows:
                    n = np.bincount(which, minlength=wide)
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n)], names=["form", "n"])
                    continue
                sizes = np.array([t.count("\n") + 1 for t in run_of], np.int64)  # lines of each text
                ends = np.cumsum(sizes)
                owner = np.searchsorted(ends, line, "right")
                taken = pa.array(first + owner)
                yield pa.RecordBatch.from_arrays([batch.column("path").take(taken), batch.column("number").take(taken), pa.array((line - (ends - sizes)[owner] + 1).astype(np.int32)), coded.dictionary.take(pa.array(which))], names=["path", "number", "line", "form"])

    return files.mapInArrow(run, kind if rows else "form string, n long")


_automata: dict[int, Automaton] = {}


def _searched(files: DataFrame, sent) -> DataFrame:
    key = hash(tuple(sent.value))
    kind = T.StructType([T.StructField("path", files.schema["path"].dataType), *T.StructType.fromDDL("line int, package string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        if key not in _automata:  # a worker builds it once
            _automata.clear()
            _automata[key] = Automaton.of(names)
        automaton, spelled = _automata[key], pa.array(names, pa.string())
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for first, run_of in _runs(texts):
                whole = codes("\n".join(run_of))
                sizes = np.array([len(t) for t in run_of], np.int64) + 1
                begins = np.cumsum(sizes) - sizes
                where, which = automaton.hits(whole)
                if not len(where):
                    continue
                breaks = np.flatnonzero(whole == 10)
                owner = np.searchsorted(begins, where, "right") - 1
                line = np.searchsorted(breaks, where) - np.searchsorted(breaks, begins[owner])
                order = np.lexsort((which, line, owner))
                owner, line, which = owner[order], line[order], which[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1]) | (which[1:] != which[:-1])
                owner, line, which = owner[new], line[new], which[new]
                yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(first + owner)), pa.array((line + 1).astype(np.int32)), spelled.take(pa.array(which))], names=["path", "line", "package"])

    return files.select("path", "text").mapInArrow(run, kind)
