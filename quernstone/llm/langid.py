"""Language identification with interpolated Kneser-Ney character models.

A word is read as its lower-case characters between two spaces, and each character is predicted from at most ORDER - 1
characters before it in the word.  For every n-gram seen in any language, the model keeps its interpolated probability
in each language; for every context, the weights with which the shorter context counts.  Both lie in arrays sorted by
the n-gram's hash.  A text's language is that with the lowest cross-entropy a character, and texts whose cross-entropy
is beyond what the language's own held-out texts have are marked as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import textvec as tv
from .columns import fold, narrow, read
from .storage import kept

ORDER = 4
BROADCAST_ROWS = 100_000
UNDETERMINED = "und"
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, ORDER + 1, dtype=np.uint64) | np.uint64(1)


def code_points(words: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Lower-case code points of UTF-8 words that single spaces separate, one space before and behind."""
    text = words.tobytes().decode("utf-8", "replace").lower()
    return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """hashes[k - 1]: of the k-gram that ends at each character but the first; lengths: the longest k that counts."""
    n = len(points) - 1
    at = np.arange(1, n + 1)
    space = np.where(points == 0x20, np.arange(n + 1), 0)
    behind = at - np.maximum.accumulate(space)[:-1]  # characters since the word's opening space, that included
    wide = points.astype(np.uint64) + np.uint64(1)
    hashes, total = [], np.zeros(n, np.uint64)
    for k in range(order):
        shifted = np.zeros(n, np.uint64)
        shifted[max(0, k - 1) :] = wide[1 - min(k, 1) : n + 1 - k] if k else wide[1:]
        total = total + shifted * _MULTIPLIERS[k]
        hashes.append(tv.mix(total + np.uint64(k + 1)))
    return hashes, np.minimum(behind + 1, order)


def contexts(points: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k - 1]: of the k - 1 characters before each character but the first, as contexts of k-grams."""
    n = len(points) - 1
    wide = points.astype(np.uint64) + np.uint64(1)
    out, total = [], np.zeros(n, np.uint64)
    for k in range(order):
        if k:
            shifted = np.zeros(n, np.uint64)
            shifted[k - 1 :] = wide[: n + 1 - k]
            total = total + shifted * _MULTIPLIERS[k]
        out.append(tv.mix(total + np.uint64(101 + k)))
    return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 where missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    """grams[k - 1], p[k - 1]: sorted hashes of k-grams, log probabilities by language; contexts, weights: likewise."""

    langs: list[str]
    grams: list[np.ndarray]
    p: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray = None  # mean, deviation a character
    sharpness: float = 1.0  # how much of a character's log odds counts

    def log_p(self, points: np.ndarray) -> np.ndarray:
        """Natural log probability of each character but the first, a column a language."""
        hashes, length = grams(points, ORDER)
        before = contexts(points, ORDER)
        out = np.zeros((len(points) - 1, len(self.langs)), np.float32)
        left = np.arange(len(points) - 1)
        for k in range(ORDER, 0, -1):
            now = left[length[left] >= k]
            place = find(self.grams[k - 1], hashes[k - 1][now])
            hit = place >= 0
            out[now[hit]] += self.p[k - 1][place[hit]]
            lost = now[~hit]
            if k > 1:
                place = find(self.contexts[k - 1], before[k - 1][lost])
                known = place >= 0
                out[lost[known]] += self.weights[k - 1][place[known]]
            else:
                out[lost] += self.floor
            left = np.concatenate([left[length[left] < k], lost])
        return out


def fit(texts: dict[str, list[str]]) -> Model:
    """Kneser-Ney models of languages over texts; their alphabet is shared."""
    langs = sorted(texts)
    points, alphabet = {}, set()
    for lang in langs:
        words = " ".join(w for t in texts[lang] for w in t.split())
        points[lang] = code_points(np.frombuffer(words.encode("utf-8", "replace"), np.uint8))
        alphabet |= set(np.unique(points[lang]).tolist())
    uniform = 1.0 / (len(alphabet) + 1)
    counts = []  # by language and order: hash -> (count, hash of suffix, hash of context, whether it opens a word)
    for lang in langs:
        hashes, length = grams(points[lang], ORDER)
        before = contexts(points[lang], ORDER)
        own = []
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(length >= k)
            keys, first, n = np.unique(hashes[k - 1][at], return_index=True, return_counts=True)
            at = at[first]
            # a word's first k-gram has nothing to its left, so its own count stands, as in the highest order
            raw = points[lang][at + 2 - k] == 0x20 if 1 < k < ORDER else np.full(len(at), k == ORDER)
            own.append({"keys": keys, "n": n.astype(float), "suffix": hashes[k - 2][at] if k > 1 else None, "context": before[k - 1][at], "raw": raw})
        for k in range(1, ORDER):  # below the highest order, count the distinct characters to the left
            left = np.zeros(len(own[k - 1]["keys"]))
            np.add.at(left, find(own[k - 1]["keys"], own[k]["suffix"]), 1)
            own[k - 1]["n"] = np.where(own[k - 1]["raw"] | (left == 0), own[k - 1]["n"], left)
        counts.append(own)

    model = Model(langs, [], [], [], [], np.full(len(langs), math.log(uniform), np.float32))
    lower: np.ndarray | None = None
    for k in range(1, ORDER + 1):
        keys, at = np.unique(np.concatenate([c[k - 1]["keys"] for c in counts]), return_index=True)
        suffix = np.concatenate([c[k - 1]["suffix"] for c in counts])[at] if k > 1 else None
        context = np.concatenate([c[k - 1]["context"] for c in counts])[at]
        base = np.full((len(keys), len(langs)), uniform) if k == 1 else lower[find(model.grams[k - 2], suffix)]
        all_contexts = np.unique(context)
        p, weights = np.empty((len(keys), len(langs))), np.ones((len(all_contexts), len(langs)))
        where = find(all_contexts, context)
        for i, own in enumerate(counts):
            c = own[k - 1]
            ones, twos = (c["n"] == 1).sum(), (c["n"] == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            n = np.zeros(len(keys))
            n[find(keys, c["keys"])] = c["n"]
            total = np.bincount(where, n, len(all_contexts))
            kinds = np.bincount(where, n > 0, len(all_contexts))
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            p[:, i] = np.maximum(n - discount, 0) / np.maximum(total, 1e-9)[where] + gamma[where] * base[:, i]
            weights[:, i] = gamma
        lower = p
        model.grams.append(keys)
        model.p.append(np.log(p).astype(np.float32))
        model.contexts.append(all_contexts)
        model.weights.append(np.log(weights).astype(np.float32))
    model.floor = model.floor + model.weights[0][0]
    return model


def cross_entropies(model: Model, texts: tv.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Nats a character of each text in each language, and its number of characters; a text without words has 0."""
    w = tv.words(texts)
    if not len(w.hashes):
        return np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    lengths = (w.ends - w.starts)[first]
    joined = np.full(int((lengths + 1).sum()) - 1, 0x20, np.uint8)
    put = np.cumsum(lengths + 1) - lengths - 1
    joined[tv.ragged(put, lengths)] = texts.data[tv.ragged(w.starts[first], lengths)]
    points = code_points(joined)
    begins = np.flatnonzero(points == 0x20)[:-1]
    sums = np.add.reduceat(model.log_p(points).astype(np.float64), begins, axis=0)
    sizes = np.diff(np.append(begins, len(points) - 1)).astype(float)
    full = np.flatnonzero(np.diff(w.offsets))
    out, chars = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    chars[full] = np.add.reduceat(sizes[inverse], w.offsets[full])
    out[full] = -np.add.reduceat(sums[inverse], w.offsets[full], axis=0) / chars[full, None]
    return out, chars


def odds(model: Model, all_h: np.ndarray, chars: np.ndarray, sharpness: float | None = None) -> np.ndarray:
    """Probabilities of the languages, a row a text."""
    s = model.sharpness if sharpness is None else sharpness
    e = np.exp(-s * (all_h - all_h.min(1, keepdims=True)) * chars[:, None])
    return e / e.sum(1, keepdims=True)


def calibrate(model: Model, texts: dict[str, list[str]]) -> None:
    """From held-out texts: mean cross-entropy and its deviation a character of each language, and the sharpness under
    which the languages of these texts are likeliest."""
    limits = np.zeros((len(model.langs), 2))
    every = [(np.zeros((0, len(model.langs))), np.zeros(0), np.zeros(0, int))]
    for i, lang in enumerate(model.langs):
        values = [cross_entropies(model, chunk) for chunk in tv.chunks(pa.array(texts.get(lang, []), pa.string()))]
        all_h, n = (np.concatenate([every[0][j], *(v[j] for v in values)]) for j in (0, 1))
        all_h, n = all_h[n > 0], n[n > 0]
        every.append((all_h, n, np.full(len(n), i)))
        h = all_h[:, i]
        limits[i] = (np.median(h), np.sqrt(np.median((h - np.median(h)) ** 2 * n) / 0.455)) if len(h) else (np.inf, 0)
    model.limits = limits
    all_h, n, true = (np.concatenate([v[j] for v in every]) for j in range(3))
    if len(n):
        loss = {s: -np.log(odds(model, all_h, n, s)[np.arange(len(n)), true] + 1e-12).mean() for s in 2.0 ** -np.arange(0, 13)}
        model.sharpness = min(loss, key=lambda s: (round(loss[s], 6), s))


def sample(docs: DataFrame, per_lang: int, lang_bytes: int) -> DataFrame:
    """Rows with lang and text, at most per_lang of each language and whole texts up to lang_bytes: those with the smallest hash."""
    rows = narrow(docs, doc_id="doc_id", text="text", lang="lang").where("text is not null and lang is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = kept(rows.groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes")
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("n"))
    drawn = rows.join(sizes, "lang").where(F.pmod("h", F.lit(1_000_003)) <= share * 1_000_003)  # no more than about twice the sample is ranked
    order = W.Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    so_far = F.sum(F.octet_length("text")).over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    return ranked.withColumn("so_far", so_far).where(F.coalesce("so_far", F.lit(0)) <= lang_bytes).drop("h", "n", "so_far")


def train(docs: DataFrame, per_lang: int = 300, lang_bytes: int = 4 << 20) -> Model | None:
    """A model from at most per_lang whole texts a language, of about lang_bytes; a fifth of them calibrates.  None without
    such texts.  Languages are few by nature: their samples come to the driver."""
    texts: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in sorted(sample(docs, per_lang, lang_bytes).collect(), key=lambda r: (r["lang"], r["rank"])):
        (held if r["rank"] % 5 == 0 else texts).setdefault(r["lang"], []).append(r["text"])
    if not texts:
        return None
    model = fit(texts)
    calibrate(model, held)
    return model


def has_letter(texts: tv.Texts) -> np.ndarray:
    d = texts.data
    ascii_letter = ((d | 0x20) >= 97) & ((d | 0x20) <= 122) & (d < 128)
    out = np.diff(np.searchsorted(np.flatnonzero(ascii_letter), texts.offsets)) > 0
    for i in np.flatnonzero(~out & (np.diff(texts.offsets) > 0)):
        out[i] = any(c.isalpha() for c in bytes(d[texts.offsets[i] : texts.offsets[i + 1]]).decode("utf-8", "replace"))
    return out


ADDED = (("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double"), ("rejected", "boolean"))


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs (text among them, none of them one of ADDED), lang_pred, score, cross_entropy, rejected.

    lang_pred is und and rejected true for a text that is null or has no letter, or without a model; of languages with equal
    cross-entropy the first by name.  score: the language's probability among the known ones, at the sharpness that fits
    the held-out texts best, as characters of a text don't stand for themselves.  rejected: the cross-entropy is more than half a nat and six deviations beyond that of the language's held-out texts.
    Equal rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for chunk in tv.chunks(batch.column("text")):
                n, letters = len(chunk), has_letter(chunk)
                part = batch.slice(chunk.first, n)
                if known is None:
                    letters[:] = False
                    best, score, h, out = np.zeros(n, int), np.zeros(n), np.zeros(n), ~letters
                else:
                    all_h, chars = cross_entropies(known, chunk)
                    best = all_h.argmin(1)
                    h = all_h[np.arange(n), best]
                    score = odds(known, all_h, chars)[np.arange(n), best]
                    mean, spread = known.limits[best].T
                    out = ~letters | (h > mean + 0.5 + 6 * spread / np.sqrt(np.maximum(chars, 1)))
                names = [known.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(h), pa.array(out)], names=[*part.schema.names, *(n for n, _ in ADDED)])

    return docs.mapInArrow(tv.lean(run), T.StructType([*docs.schema, *(T.StructField(n, T.DataType.fromDDL(k)) for n, k in ADDED)]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and what annotate() adds; other columns of docs than doc_id and text are left out."""
    return annotate(narrow(docs, doc_id="doc_id", text="text"), model).drop("text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all `documents`; see `train` and `identify` for nulls, repeated rows and empty tables."""
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    rows = identify(docs, train(docs.where(~held)))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op5_language_id": op5_language_id}
