"""Quality rules as a short-circuit cascade.

Each rule is a test on a document's measures.  On a sample of the documents the costs of measures and tests and the sets of
rules that reject a document are found.  From these the rules are put in order one by one: next is the one that rejects most
per second of what the others left, measures that are at hand by then costing nothing.  A rule sees only what the rules before it have left.  The order changes the
time that a run takes, never its verdict, as a document is kept exactly if no rule rejects it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .columns import narrow, read

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LEAD = np.ones(256, bool)
_IS_LEAD[128:192] = False


class Measures:
    """Measures of the texts of a chunk, each computed when it is first asked for."""

    def __init__(self, texts: tv.Texts):
        self.texts, self.words, self._known = texts, tv.words(texts), {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, name)()
        return self._known[name]

    def part(self, keep: np.ndarray) -> Measures:
        """Measures of the texts for which keep holds; what is known of them is taken over."""
        found = Measures(part(self.texts, keep))
        found._known = {name: values[keep] for name, values in self._known.items() if name != "line"}
        return found

    def _bytes_per_text(self, table: np.ndarray) -> np.ndarray:
        t = self.texts
        return np.diff(np.searchsorted(np.flatnonzero(table[t.data]), t.offsets))

    def n_words(self) -> np.ndarray:
        return np.diff(self.words.offsets)

    def word_chars(self) -> np.ndarray:
        return self._bytes_per_text(_IS_LEAD & ~tv.WHITE)

    def n_symbols(self) -> np.ndarray:
        return self._bytes_per_text(_IS_SYMBOL)

    def n_letters(self) -> np.ndarray:
        return self._bytes_per_text(_IS_LETTER & _IS_LEAD)

    def n_upper(self) -> np.ndarray:
        return self._bytes_per_text(_IS_UPPER)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each line that has a word; a line's white space counts."""
        t, w = self.texts, self.words
        breaks = np.flatnonzero(t.data == 0x0A)
        edges = np.unique(np.concatenate([t.offsets[:-1], t.offsets[1:], breaks + 1]))
        firsts, lasts = edges[:-1], edges[1:]
        full = np.searchsorted(w.starts, lasts) > np.searchsorted(w.starts, firsts)
        codes = tv._CODES | np.uint64(1)
        codes[0x0A] = 0
        hashes = tv.hash_spans(t.data, codes, firsts, lasts - (t.data[lasts - 1] == 0x0A))
        return np.searchsorted(t.offsets, firsts[full], "right") - 1, hashes[full]

    def n_lines(self) -> np.ndarray:
        self._known["line"] = self._known.get("line") or self._lines()
        return np.bincount(self._known["line"][0], minlength=len(self.texts))

    def n_dup_lines(self) -> np.ndarray:
        self._known["line"] = self._known.get("line") or self._lines()
        owner, hashes = self._known["line"]
        distinct = np.unique(tv.mix(hashes ^ tv.mix(owner.astype(np.uint64))), return_index=True)[1]
        return np.bincount(owner, minlength=len(self.texts)) - np.bincount(owner[distinct], minlength=len(self.texts))

    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        hashes, at = tv.windows(w, WINDOW)
        if not len(hashes):
            return np.zeros(len(self.texts), np.int64)
        owner = w.owner
        keys = tv.mix(hashes ^ tv.mix(owner[at].astype(np.uint64)))
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        first = at[again]
        change = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + WINDOW, -1)
        return np.bincount(owner[np.cumsum(change)[:-1] > 0], minlength=len(self.texts))


class Left:
    """The texts of a chunk that no rule has rejected yet.

    Known measures are taken by index.  An unknown one is computed for what is left; where that is over half of the
    texts at hand, for all of those, since measuring some for nothing costs less than a copy of the others.
    """

    def __init__(self, measures: Measures):
        self._held, self.at = measures, np.arange(len(measures.texts))
        self._places = self.at  # of what is left among the texts held

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._held._known and 2 * len(self._places) < len(self._held.texts):
            keep = np.zeros(len(self._held.texts), bool)
            keep[self._places] = True
            self._held, self._places = self._held.part(keep), np.arange(len(self.at))
        return self._held[name][self._places]

    def drop(self, gone: np.ndarray) -> None:
        self.at, self._places = self.at[~gone], self._places[~gone]


@dataclass(frozen=True)
class Rule:
    """rejects(measures) says which texts of a chunk go; needs: the measures that it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measures], np.ndarray]


#: Thresholds in the style of published web-corpus filters.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("letters", ("word_chars", "n_letters"), lambda m: 2 * m["n_letters"] < m["word_chars"]),
    Rule("capitals", ("n_letters", "n_upper"), lambda m: 2 * m["n_upper"] > m["n_letters"]),
    Rule("lines", ("n_lines", "n_dup_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
)
BASE = ("few_words", "repeats")


def part(texts: tv.Texts, keep: np.ndarray) -> tv.Texts:
    """The texts for which keep holds."""
    if keep.all():
        return texts
    starts, lengths = texts.offsets[:-1][keep], np.diff(texts.offsets)[keep]
    return tv.Texts(texts.data[tv.ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)]), texts.first)


@dataclass
class Profile:
    """What a sample says: seconds a document of each measure and of each rule's own test, and how many documents each set
    of rules (bits in the rules' order) rejects."""

    measures: dict[str, float]
    tests: dict[str, float]
    rejected: dict[int, int]


def estimate(docs: DataFrame, rules=RULES, sample: int = 2000) -> Profile:
    """The profile of about `sample` documents, drawn by a hash.

    Measures are timed one after the other on texts whose words are known, and tests on known measures, so a sum of them is
    what a rule costs beside the measures that are at hand.  All is measured where the sample lies; only sums come to the driver.
    """
    rows = narrow(docs, doc_id="doc_id", text="text")
    share = sample / max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) <= math.ceil(share * 1_000_003)) if share < 1 else rows
    names = list(dict.fromkeys(n for r in rules for n in r.needs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column("text")):
                m, found, mask = Measures(chunk), [], np.zeros(len(chunk), np.int64)
                for name in names:
                    began = time.perf_counter()
                    m[name]
                    found.append(("measure", name, time.perf_counter() - began, len(chunk)))
                for bit, r in enumerate(rules):
                    began = time.perf_counter()
                    gone = r.rejects(m)
                    found.append(("test", r.name, time.perf_counter() - began, len(chunk)))
                    mask |= gone.astype(np.int64) << bit
                found += [("rejected", str(k), 0.0, int(n)) for k, n in zip(*np.unique(mask, return_counts=True), strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(("what", "name", "seconds", "n"), f, strict=True)) for f in found])

    sums = drawn.mapInArrow(run, "what string, name string, seconds double, n long").groupBy("what", "name").agg(F.sum("seconds"), F.sum("n")).collect()  # 2^rules rows at most
    of = lambda what: {r[1]: r[2] / r[3] for r in sums if r[0] == what}
    return Profile(of("measure"), of("test"), {int(r[1]): r[3] for r in sums if r[0] == "rejected"})


def best_order(profile: Profile, rules=RULES, known: tuple[str, ...] = ()) -> list[str]:
    """Rule names, each the one with most rejections per second among those left: of the documents that the rules before it
    leave, and at the cost of its test and of the measures that neither `known` nor those rules have asked for.  Ties keep the
    given order."""
    order: list[str] = []
    have, passed, left = set(known), 0, list(enumerate(rules))
    while left:

        def worth(item: tuple[int, Rule]) -> float:
            bit, r = item
            gone = sum(n for mask, n in profile.rejected.items() if mask >> bit & 1 and not mask & passed)
            cost = profile.tests.get(r.name, 0.0) + sum(profile.measures.get(m, 0.0) for m in r.needs if m not in have)
            return gone / max(cost, 1e-12)

        chosen = max(left, key=worth)
        left.remove(chosen)
        order.append(chosen[1].name)
        have.update(chosen[1].needs)
        passed |= 1 << chosen[0]
    return order


def cascade_order(docs: DataFrame, rules=RULES, sample: int = 2000, known: tuple[str, ...] = ()) -> list[str]:
    """Rule names in the order of a sample's `best_order`; known: measures that are computed in any case."""
    return best_order(estimate(docs, rules, sample), rules, known)


def cascade(docs: DataFrame, rules=RULES, order: list[str] | None = None, measures: tuple[str, ...] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), sample: int = 2000) -> DataFrame:
    """doc_id, the asked measures, failed_rule (the first that rejects; null for a kept document), kept.

    docs has doc_id and text; other columns are left out.  A null or empty text has measures 0.  Equal rows get equal
    results and each stays.  An empty table gives no rows.  The asked measures are computed for each document, the
    others only for what earlier rules left; measures=() is the pure filter.
    """
    docs = narrow(docs, doc_id="doc_id", text="text")
    by_name = {r.name: r for r in rules}
    ranked = [by_name[n] for n in (order or cascade_order(docs, rules, sample, measures))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column("text")):
                n, m = len(chunk), Measures(chunk)
                out = {name: m[name] for name in measures}
                failed = np.full(n, -1)
                left = Left(m)
                for i, rule in enumerate(ranked):
                    gone = rule.rejects(left)
                    failed[left.at[gone]] = i
                    left.drop(gone)
                    if not len(left):
                        break
                failed_first = pa.array([None if f < 0 else ranked[f].name for f in failed], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, n), *(pa.array(v.astype(np.int64)) for v in out.values()), failed_first, pa.array(failed < 0)], names=["doc_id", *out, "failed_rule", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {''.join(f'{m} long, ' for m in measures)}failed_rule string, kept boolean")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all `documents`; see `cascade` for nulls, repeated rows and empty tables."""
    rows = cascade(read(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


QUERIES = {"op7_quality_rules": op7_quality_rules}
