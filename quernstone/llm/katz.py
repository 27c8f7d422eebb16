"""Katz backoff model of words, of any order, learned and applied where the texts lie.

For a word w after a history h (at most ORDER - 1 words of the same text, the beginning of a text among them),
P(w | h) is D(r) / c(h) if h w was seen r times, at least `least[order]` times, and alpha(h) * P(w | h') otherwise, with
the history h' that is shorter by its first word; a history that was never seen has alpha 1.  The recursion ends at
single words: D(c) / N for a known one, and what is left for the class of all unknown ones.  D(r) is d(r) * r with
Good-Turing discounts d for r up to K, and r - TAIL above K, so every history keeps some mass.
alpha(h) = (1 - sum of P(w | h)) / (1 - sum of P(w | h')), both sums over the words that the table has after h, so each
distribution adds up to one exactly.

A corpus is cut into batches of whole texts, stored as numbers of their words.
1. A batch asks for its distinct n-grams of all orders, each once, with its own training count, at the buckets in which
   their hashes lie.  A bucket adds up the counts, stores its part of the table, answers each batch, and names the first
   batch that has an n-gram in training as the one to account for it.
2. With the counts of counts the discounts are known.  A batch scores its texts but for the backoff weights, sends the
   masses of the n-grams that it accounts for to the buckets of their histories, and asks for the weights it lacks.
3. The buckets store the backoff weights and answer, and the texts' scores are completed.
An n-gram travels once a batch, however frequent it is, so no key is hot.  Words have hashes of 64 bits; those of longer
n-grams have 20 bits more than it takes to number all n-grams, so about one in a million shares its hash with another.
What is moved are arrays, byte planes compressed, one row per batch and bucket: at 100 TB raise BATCH_TOKENS and
BUCKET_TOKENS with the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .columns import fold, narrow, read
from .storage import drop, shared_dir, stored

K, TAIL = 5, 0.1
ORDER = 3
BATCH_TOKENS, BUCKET_TOKENS = 1_000_000, 2_500_000
LEAST_BUCKETS = 128
END, BEGIN = np.uint64(0x8F14E45FCEEA167A), np.uint64(0xC81E728D9D4C2F63)
_FOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray, kind: str) -> bytes:
    """Byte planes of the values, compressed."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer() if isinstance(data, pa.Scalar) else data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)), "<u8")


def unpack_keys(data) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, rising, and the index of each value among them."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(values), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], at


def default_least(order: int) -> tuple[int, ...]:
    """How often an n-gram must be seen to be in the table: once up to bigrams, twice above, as is usual for such models."""
    return tuple(1 if k <= 2 else 2 for k in range(1, order + 1))


@dataclass
class Shape:
    """Of a model: its order, least counts by order, number of buckets, and the bits of the hash of two words or more."""

    order: int
    least: tuple[int, ...]
    buckets: int
    bits: int

    def cut(self, k: int, keys: np.ndarray) -> list[int]:
        """Borders of the buckets in an array of rising keys of k-grams: each bucket has an equal range of keys."""
        bits = 64 if k == 1 else self.bits
        edges = np.array([(i << bits) // self.buckets for i in range(1, self.buckets)], np.uint64)
        return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


# ---- batches ----------------------------------------------------------------------------------------------------------

BATCHES = "batch long, words binary, codes binary, lengths binary, ids binary, missing binary, train binary"


def batches_of(docs: DataFrame) -> DataFrame:
    """A row a batch: its distinct words' hashes by falling count, the places of its tokens among them (an end behind each
    text), and its texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lengths, ids, train, held, n = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            words, codes = distinct(np.concatenate(tokens))
            by_count = np.argsort(-np.bincount(codes), kind="stable")
            place = np.empty(len(words), np.int32)
            place[by_count] = np.arange(len(words))
            words, codes = words[by_count], place[codes]
            i = pa.concat_arrays(ids).cast(pa.int64())
            cells = (pack(words, "<u8"), pack(codes, "<u4"), pack(np.concatenate(lengths), "<u4"), pack(i.fill_null(0).to_numpy(), "<i8"), pack(i.is_null().to_numpy(zero_copy_only=False), "u1"), pack(np.concatenate(train), "u1"))
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 24 | n], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=[c.split()[0] for c in BATCHES.split(", ")])

        for row in rows:
            for chunk in tv.chunks(row.column("text")):
                w = tv.words(chunk, lower=True)
                size = np.diff(w.offsets) + 1
                out = np.full(int(size.sum()), END)
                word = np.ones(len(out), bool)
                word[np.cumsum(size) - 1] = False
                out[word] = w.hashes
                tokens.append(out)
                lengths.append(size)
                ids.append(row.column("doc_id").slice(chunk.first, len(chunk)))
                train.append(row.column("train").slice(chunk.first, len(chunk)).to_numpy(zero_copy_only=False).astype(bool))
                held += len(out)
                if held >= BATCH_TOKENS:
                    yield close()
                    tokens, lengths, ids, train, held, n = [], [], [], [], 0, n + 1
        if tokens:
            yield close()

    return docs.mapInArrow(run, BATCHES)


class Grams:
    """The n-grams of a batch.  Its texts stand in a row, a beginning before each, so that place j is a token or a beginning.

    keys[k - 1]: the distinct k-grams' hashes, rising, that of the beginning among the 1-grams; at[k - 1]: for each place,
    the index of the k-gram that ends there, -1 where no text has one (a beginning, or too few places before).
    """

    def __init__(self, batch: dict, shape: Shape):
        shift = np.uint64(64 - shape.bits)
        words, codes = np.append(unpack(batch["words"], "<u8"), BEGIN), unpack(batch["codes"], "<u4")
        lengths = unpack(batch["lengths"], "<u4").astype(np.int64)
        self.lengths, self.train, self.shape = lengths, unpack(batch["train"], "u1").astype(bool), shape
        n = len(codes) + len(lengths)
        begins = np.cumsum(lengths + 1) - lengths - 1
        self.token = np.ones(n, bool)
        self.token[begins] = False
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        keys, place = distinct(words)
        at = np.full(n, place[-1], np.int32)
        at[self.token] = place[codes]
        self.keys, self.at = [keys], [at]
        one = whole = keys[at]
        before = np.arange(n) - begins[self.owner]  # places of the text before each place
        for k in range(2, shape.order + 1):
            whole = np.concatenate([whole[:1], tv.mix(whole[:-1] * _STEP + one[1:] * _FOLD + np.uint64(k))])
            valid = before >= k - 1
            keys, inverse = distinct(whole[valid] >> shift)
            at = np.full(n, -1, np.int32)
            at[valid] = inverse
            self.keys.append(keys)
            self.at.append(at)

    def counts(self, k: int) -> np.ndarray:
        """How often the batch's training texts have each k-gram; the beginning is none."""
        seen = self.token & self.train[self.owner]
        at = self.at[k - 1][seen]
        return np.bincount(at[at >= 0], minlength=len(self.keys[k - 1]))


# ---- counts -----------------------------------------------------------------------------------------------------------


def requests(batches: DataFrame, shape: Shape) -> DataFrame:
    """bucket, batch, keys and counts by order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch in row.to_pylist():
                g = Grams(batch, shape)
                cuts = [shape.cut(k, keys) for k, keys in enumerate(g.keys, 1)]
                counts = [g.counts(k) for k in range(1, shape.order + 1)]
                out = [(b, [pack_keys(keys[c[b] : c[b + 1]]) for keys, c in zip(g.keys, cuts, strict=True)], [pack(n[c[b] : c[b + 1]], "<u4") for n, c in zip(counts, cuts, strict=True)]) for b in range(shape.buckets)]
                number, keys, counts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([batch["batch"]] * len(out), pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.binary()))], names=["bucket", "batch", "keys", "counts"])

    return batches.mapInArrow(run, "bucket int, batch long, keys array<binary>, counts array<binary>")


COUNTED = "bucket int, batch long, keys array<binary>, totals array<binary>, own array<binary>, n_r array<array<long>>, tokens long, kinds long"


def counted(asked: DataFrame, shape: Shape) -> DataFrame:
    """batch null: the bucket's part of the table (keys and counts by order), and its counts of counts; else a batch's
    totals, and whether it is the first that has the n-gram in training."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        bucket, n = table.column("bucket")[0].as_py(), len(table)
        keys, totals, n_r = [], [], []
        answers = [([], []) for _ in range(n)]
        tokens = kinds = 0
        for k in range(shape.order):
            lists = [unpack_keys(x.values[k]) for x in table.column("keys")]
            own = np.concatenate([unpack(x.values[k], "<u4") for x in table.column("counts")]).astype(np.int64)
            every = np.concatenate(lists)
            grams, inverse = distinct(every)
            total = np.bincount(inverse, own, len(grams)).astype(np.int64)
            first = np.full(len(grams), len(every))
            trained = np.flatnonzero(own > 0)
            first[inverse[trained][::-1]] = trained[::-1]  # of repeated places the last one stands, so this is the first
            lead = np.zeros(len(every) + 1, bool)
            lead[first] = True
            borders = np.cumsum([0, *map(len, lists)])
            for (t, o), i, j in zip(answers, borders, borders[1:], strict=False):
                t.append(pack(total[inverse[i:j]], "<u8"))
                o.append(pack(lead[i:j], "u1"))
            kept = total >= shape.least[k]
            keys.append(pack_keys(grams[kept]))
            totals.append(pack(total[kept], "<u8"))
            n_r.append([int((total == r).sum()) for r in range(1, K + 2)])
            if k == 0:
                tokens, kinds = int(total.sum()), int((total > 0).sum())
        lists = pa.list_(pa.binary())
        return pa.table({
            "bucket": pa.array([bucket] * (n + 1), pa.int32()), "batch": pa.array([None, *table.column("batch").to_pylist()], pa.int64()), "keys": pa.array([keys] + [None] * n, lists),
            "totals": pa.array([totals, *(t for t, _ in answers)], lists), "own": pa.array([None, *(o for _, o in answers)], lists), "n_r": pa.array([n_r] + [None] * n, pa.list_(pa.list_(pa.int64()))),
            "tokens": pa.array([tokens] + [None] * n, pa.int64()), "kinds": pa.array([kinds] + [None] * n, pa.int64()),
        })

    return asked.groupBy("bucket").applyInArrow(run, COUNTED)


def discounts(n_r: np.ndarray, least: int = 1) -> np.ndarray:
    """Good-Turing d(1) .. d(K) from the numbers n_r of types seen 1 .. K + 1 times; those below `least` are 0.

    Where the counts are too odd for the formula (some d not in (0, 1)), an absolute discount takes its place.
    """
    n, r = n_r.astype(float), np.arange(1, K + 1)
    out = 1 - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5) / r
    if (n > 0).all():
        a = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - a) / (1 - a) if a != 1 else np.zeros(K)
        if ((d > 0) & (d < 1)).all():
            out = d
    return np.where(r < least, 0.0, out)


@dataclass
class Rules:
    """What all tasks know of a model: discounts by order, tokens, kinds and texts in training, P of all unknown words."""

    shape: Shape
    d: np.ndarray
    tokens: int
    kinds: int
    texts: int
    unknown: float

    @classmethod
    def of(cls, shape: Shape, n_r: np.ndarray, tokens: int, kinds: int, texts: int) -> Rules:
        d = np.stack([discounts(n, least) for n, least in zip(n_r, shape.least, strict=True)])
        r = np.arange(1, K + 1)
        low = n_r[0][:K]
        mass = (d[0] * r * low).sum() + (tokens - (r * low).sum()) - TAIL * (kinds - low.sum())
        return cls(shape, d, tokens, kinds, texts, 1 - mass / tokens if tokens else 1.0)

    def cut(self, k: int, r: np.ndarray) -> np.ndarray:
        """D(r) of k-grams; 0 for those that the table doesn't have."""
        d = np.append(0, self.d[k - 1] * np.arange(1, K + 1))
        return np.where(r > K, r - TAIL, d[np.minimum(r, K)])


# ---- scores -----------------------------------------------------------------------------------------------------------

SENT = "bucket int, batch long, keys array<binary>, mass array<binary>, low array<binary>, c array<binary>, asked array<binary>, meta array<binary>, lost_text array<binary>, lost_at array<binary>"


def partial_scores(batches: DataFrame, answers: DataFrame, rules: Rules) -> DataFrame:
    """meta null: what a batch sends to histories' buckets (masses and sums of lower probabilities of the n-grams it
    accounts for, and the histories whose weights it asks for).  Else, one row a batch, meta: ids, missing, train, lengths,
    n_known, base score and partial score of its texts; lost_text, lost_at: by order of the history, which text misses
    which of the asked weights."""
    shape = rules.shape

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.to_pylist()[0]
        g = Grams(batch, shape)
        right = right.sort_by("bucket")
        n = len(g.token)
        r, own, kept = [], [], []
        for k in range(shape.order):
            total = np.concatenate([unpack(x.values[k], "<u8") for x in right.column("totals")]).astype(np.int64)
            at = g.at[k]
            r.append(np.append(total, 0)[at])  # by place
            own.append(np.concatenate([unpack(x.values[k], "u1") for x in right.column("own")]).astype(bool) & (total >= shape.least[k]))
            kept.append(r[k] >= shape.least[k])
        known = r[0] > 0
        base = np.log10((r[0] + 0.5) / (rules.tokens + 0.5 * (rules.kinds + 1)))
        c = [np.where(g.token, r[0], rules.texts), *r[1:]]  # of histories that end at a place; the beginning is one too
        with np.errstate(divide="ignore", invalid="ignore"):
            p = [np.where(known, rules.cut(1, r[0]) / max(rules.tokens, 1), rules.unknown)]
            for k in range(1, shape.order):
                p.append(np.append(0, rules.cut(k + 1, r[k][1:]) / c[k - 1][:-1]))

        score = np.zeros(n)
        todo = g.token.copy()
        lost = []
        for k in range(shape.order - 1, 0, -1):
            hit = todo & kept[k] & (g.at[k] >= 0)
            score[hit] = np.log10(p[k][hit])
            todo &= ~hit
            # a history that may have a weight: one that was seen as often as an n-gram of the table must be
            miss = np.flatnonzero(todo & (g.at[k] >= 0) & np.append(False, c[k - 1][:-1] >= shape.least[k]))
            lost.insert(0, (g.owner[miss], g.at[k - 1][miss - 1]))
        score[todo] = np.log10(p[0][todo])
        sums = lambda x: np.bincount(g.owner[g.token], x[g.token], len(g.lengths))
        meta = [batch["ids"], batch["missing"], batch["train"], batch["lengths"], pack(sums(known.astype(float)), "<u4"), pack(sums(base), "<f8"), pack(sums(score), "<f8")]

        rows: list[list] = [[] for _ in range(5)]
        cuts, sent, lost_text, lost_at = [], [], [], []
        for k in range(1, shape.order):  # histories are k-grams
            size = len(g.keys[k - 1])
            place = np.full(len(g.keys[k]), -1)
            ends = np.flatnonzero(g.at[k] >= 0)
            place[g.at[k][ends]] = ends
            types = place[own[k]]
            history = g.at[k - 1][types - 1]
            mass = np.bincount(history, rules.cut(k + 1, r[k][types]), size)
            low = np.bincount(history, p[k - 1][types], size)
            count = np.zeros(size, np.int64)
            count[history] = c[k - 1][types - 1]
            use = np.flatnonzero(mass)
            asked, where = np.unique(lost[k - 1][1], return_inverse=True)
            lost_text.append(pack(lost[k - 1][0], "<u4"))
            lost_at.append(pack(where, "<u4"))
            keys = g.keys[k - 1]
            sent.append((keys[use], mass[use], low[use], count[use], keys[asked]))
            cuts.append((shape.cut(k, keys[use]), shape.cut(k, keys[asked])))
        for b in range(shape.buckets):
            parts = [[x[u[b] : u[b + 1]] for x in (keys, mass, low, count)] + [asked[a[b] : a[b + 1]]] for (keys, mass, low, count, asked), (u, a) in zip(sent, cuts, strict=True)]
            for column, i, packed in zip(rows, range(5), (pack_keys, lambda x: pack(x, "<f8"), lambda x: pack(x, "<f8"), lambda x: pack(x, "<u8"), pack_keys), strict=True):
                column.append([packed(part[i]) for part in parts])
        m, lists = shape.buckets, pa.list_(pa.binary())
        return pa.table({
            "bucket": pa.array([*range(m), int(tv.mix(np.array([batch["batch"]]))[0]) % m], pa.int32()), "batch": pa.array([batch["batch"]] * (m + 1), pa.int64()), **{name: pa.array([*x, None], lists) for name, x in zip(("keys", "mass", "low", "c", "asked"), rows, strict=True)},
            **{name: pa.array([None] * m + [x], lists) for name, x in (("meta", meta), ("lost_text", lost_text), ("lost_at", lost_at))},
        })

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, SENT)


def backoff(sent: DataFrame, shape: Shape) -> DataFrame:
    """batch null: histories and log10 of their backoff weights, by order; else the weights that a batch asked for, 0 for
    histories that the table doesn't have, or what a batch has kept for itself (meta)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        own = table.filter(pa.compute.is_valid(table.column("meta"))).select(["batch", "meta", "lost_text", "lost_at"])
        table = table.filter(pa.compute.is_null(table.column("meta"))).sort_by("batch")
        keys, weights, answers = [], [], [[] for _ in range(len(table))]
        for k in range(shape.order - 1):
            every = np.concatenate([unpack_keys(x.values[k]) for x in table.column("keys")])
            grams, inverse = distinct(every)
            mass, low, c = (np.concatenate([unpack(x.values[k], kind) for x in table.column(name)]) for name, kind in (("mass", "<f8"), ("low", "<f8"), ("c", "<u8")))
            count = np.zeros(len(grams))
            count[inverse] = c  # the same in each batch
            alpha = np.log10((1 - np.bincount(inverse, mass, len(grams)) / count) / (1 - np.bincount(inverse, low, len(grams)))) if len(grams) else np.zeros(0)
            keys.append(pack_keys(grams))
            weights.append(pack(alpha, "<f8"))
            for answer, x in zip(answers, table.column("asked"), strict=True):
                asked = unpack_keys(x.values[k])
                at = np.minimum(np.searchsorted(grams, asked), max(0, len(grams) - 1))
                answer.append(pack(np.where(grams[at] == asked, alpha[at], 0.0) if len(grams) else np.zeros(len(asked)), "<f8"))
        lists, n, m = pa.list_(pa.binary()), len(table), len(own)
        kept = {name: pa.concat_arrays([pa.nulls(n + 1, lists), own.column(name).combine_chunks().cast(lists)]) for name in ("meta", "lost_text", "lost_at")}
        batch = pa.array([None, *table.column("batch").to_pylist(), *own.column("batch").to_pylist()], pa.int64())
        return pa.table({"bucket": pa.array([bucket] * (n + 1 + m), pa.int32()), "batch": batch, "keys": pa.array([keys] + [None] * (n + m), lists), "weights": pa.array([weights, *answers, *[None] * m], lists), **kept})

    return sent.groupBy("bucket").applyInArrow(run, "bucket int, batch long, keys array<binary>, weights array<binary>, meta array<binary>, lost_text array<binary>, lost_at array<binary>")


def finish(weights: DataFrame, shape: Shape) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score."""

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_valid(table.column("meta")))
        table = table.filter(pa.compute.is_null(table.column("meta"))).sort_by("bucket")
        ids, missing, train, length, known, base, score = (unpack(x, kind) for x, kind in zip(own.column("meta")[0].values, ("<i8", "u1", "u1", "<u4", "<u4", "<f8", "<f8"), strict=True))
        score = score.copy()
        for k in range(shape.order - 1):
            weight = np.concatenate([unpack(x.values[k], "<f8") for x in table.column("weights")])
            text, at = (unpack(own.column(name)[0].values[k], "<u4") for name in ("lost_text", "lost_at"))
            score += np.bincount(text, weight[at], len(score))
        return pa.table([pa.array(ids, mask=missing.astype(bool)), pa.array(train.astype(bool)), pa.array(length.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return weights.groupBy("batch").applyInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def _table(rows: DataFrame, values: str, kind: str, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, found in zip(batch.column("keys"), batch.column(values), strict=True):
                for k, (a, b) in enumerate(zip(keys.values, found.values, strict=True), 1):
                    gram, value = unpack_keys(a).astype(np.int64), unpack(b, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram), pa.array(value.astype(np.int64) if kind == "<u8" else value)], names=["n", "gram", name])

    return rows.where("batch is null").select("keys", values).mapInArrow(run, f"n int, gram long, {name} {'long' if kind == '<u8' else 'double'}")


@dataclass
class Scored:
    """rows: doc_id, train, n_tokens, n_known, base_score, score.  tables, weights: the stored model, a row a bucket."""

    rows: DataFrame
    tables: DataFrame
    weights: DataFrame
    rules: Rules

    def ngrams(self) -> DataFrame:
        """n, gram (hash), count of the n-grams of the model."""
        return _table(self.tables, "totals", "<u8", "count")

    def backoffs(self) -> DataFrame:
        """n, gram (hash), log_alpha of the histories of the model; all others have 0."""
        return _table(self.weights, "weights", "<f8", "log_alpha")


def learn_and_score(docs: DataFrame, train: str = "train", order: int = ORDER, least: tuple[int, ...] | None = None) -> Scored:
    """Scores of all rows under the model of those whose `train` column is true.

    docs: doc_id (a whole number), text, train; other columns are left out.  Words are runs of bytes other than white
    space, with A-Z in lower case, and one end follows each text, so a null or empty text is one token.  A null `train`
    counts as false.  Equal rows count and are scored each.  least: how often an n-gram of each order must be seen to be in
    the table, not falling; the mass of those left out goes to the shorter histories.  Without training texts every word
    is unknown and has probability one; an empty table gives no rows.
    """
    least = least or default_least(order)
    if order < 1 or len(least) != order or least[0] != 1 or list(least) != sorted(least) or least[-1] > K:
        raise ValueError(f"least must be {order} numbers from 1 to {K} that don't fall, the first of them 1")
    spark = docs.sparkSession
    docs = narrow(docs, doc_id="doc_id", text="text", train=train).withColumn("train", F.coalesce("train", F.lit(False)))
    size, texts = docs.agg(F.sum(F.octet_length("text") + 6), F.sum(F.col("train").cast("long"))).first()
    tokens = (size or 0) // 6
    shape = Shape(order, tuple(least), max(LEAST_BUCKETS, tokens // BUCKET_TOKENS), min(64, max(40, (tokens * order).bit_length() + 20)))
    paths = [shared_dir(spark, f"katz-{what}") for what in ("batches", "counts", "backoff")]
    batches = stored(batches_of(docs), paths[0])
    counts = stored(counted(requests(batches, shape), shape), paths[1])
    tables = counts.where("batch is null")
    found = tables.agg(*(F.sum(F.col("n_r")[k][i]) for k in range(order) for i in range(K + 1)), F.sum("tokens"), F.sum("kinds")).first()
    n_r = np.array([x or 0 for x in found[:-2]], np.int64).reshape(order, K + 1)
    rules = Rules.of(shape, n_r, found[-2] or 0, found[-1] or 0, texts or 0)
    partial = partial_scores(batches, counts.where("batch is not null").select("bucket", "batch", "totals", "own"), rules)
    weights = stored(backoff(partial, shape), paths[2])
    drop(spark, paths[0])
    rows = finish(weights.where("batch is not null").select("bucket", "batch", "weights", "meta", "lost_text", "lost_at"), shape)
    return Scored(rows, tables, weights, rules)


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams: tables of trigrams and what is sent for them take more than four times the input's disk (see the README)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = learn_and_score(docs.withColumn("train", fold(F.col("doc_id"), 5) != 1), order=2)
    return scored.rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(scored.rules.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op2_katz_scores": op2_katz_scores}
