"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words, hashed into WORDS columns, pairs of neighbouring characters by class (capital, small letter, digit, each
sign by itself), and marks of words that repeat a word shortly before.  Labelled texts are weighed by inverse document
frequency and projected on their leading singular vectors.  The labelled vectors are broadcast; a block of documents is
projected and multiplied with all of them exactly, and the nearest neighbours' labels are averaged by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .columns import fold, narrow, read

#: Classes of bytes. 0 other letters, 1 small letters, 2 capitals, 3 digits, 4 space, 5 line break, then each ASCII sign by itself.
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[9, 11, 12, 13, 32]] = 4
CLASS[10] = 5
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS[_SIGNS] = np.arange(6, 6 + len(_SIGNS))
CLASSES = 6 + len(_SIGNS)
LAGS = (1, 2, 3, 4, 6, 8)
WORDS = 4096
PAIRS = CLASSES * CLASSES
TERMS = PAIRS + 2 * len(LAGS) + WORDS
BLOCK = 512


def term_weights(texts: tv.Texts) -> np.ndarray:
    """Damped frequencies of each text's terms, a row a text; a text without words has zeros."""
    n, d = len(texts), texts.data
    out = np.zeros((n, TERMS), np.float32)
    if len(d) > 1:
        owner = np.repeat(np.arange(n), np.diff(texts.offsets))
        c = CLASS[d]
        inside = owner[1:] == owner[:-1]
        keys = (owner[1:] * PAIRS + c[:-1] * CLASSES + c[1:])[inside]
        out[:, :PAIRS] = np.bincount(keys, minlength=n * PAIRS).reshape(n, -1)
        out[:, :PAIRS] /= np.maximum(np.diff(texts.offsets), 1)[:, None]
    w = tv.words(texts, lower=True)
    counts = np.diff(w.offsets)
    whose = w.owner
    for i, lag in enumerate(LAGS):
        same = (w.hashes[lag:] == w.hashes[:-lag]) & (whose[lag:] == whose[:-lag])
        share = np.bincount(whose[lag:][same], minlength=n) / np.maximum(counts, 1)
        out[:, PAIRS + 2 * i] = share
        out[:, PAIRS + 2 * i + 1] = np.maximum(share - 0.1, 0)
    column = ((w.hashes >> np.uint64(40)) & np.uint64(WORDS - 1)).astype(np.int64)
    out[:, TERMS - WORDS :] = np.bincount(whose * WORDS + column, minlength=n * WORDS).reshape(n, -1)
    out[:, TERMS - WORDS :] /= np.maximum(counts, 1)[:, None]
    out = np.log1p(1000 * out)
    out[counts == 0] = 0
    return out


@dataclass
class Voters:
    """idf: of terms; axes: projection; vectors, labels: of labelled texts, each of length 1; empty: score of a text
    without words, the mean label of the labelled texts with the fewest terms."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float
    empty: float

    def project(self, weights: np.ndarray) -> np.ndarray:
        v = (weights * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Weighed share of label 1 among the nearest, all that are as near as the last of them included."""
        cosine = self.project(weights) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        last = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
        vote = np.where(cosine >= last[:, None] - 1e-5, np.maximum(cosine, 0) ** self.power + 1e-9, 0)
        return np.where(weights.any(1), np.clip(vote @ self.labels / vote.sum(1), 0, 1), self.empty).astype(np.float64)


def voters(weights: np.ndarray, labels: np.ndarray, dimensions: int = 64, neighbours: int = 15, power: float = 8.0) -> Voters:
    idf = np.log((1 + len(weights)) / (1 + (weights > 0).sum(0))).astype(np.float32) + 1
    weighed = (weights * idf).astype(np.float32)
    values, left = np.linalg.eigh((weighed @ weighed.T).astype(np.float64))  # rows x rows: singular vectors by way of the Gram matrix
    chosen = np.argsort(-values)[:dimensions]
    chosen = chosen[values[chosen] > 1e-9 * max(values.max(initial=0), 1e-9)]
    axes = (weighed.T @ left[:, chosen] / np.sqrt(values[chosen])).astype(np.float32)
    kinds = (weights > 0).sum(1)
    fewest = np.sort(kinds)[min(neighbours, len(kinds)) - 1]
    v = Voters(idf, np.ascontiguousarray(axes), np.zeros(0), labels.astype(np.float32), neighbours, power, float(labels[kinds <= fewest].mean()))
    v.vectors = v.project(weights).astype(np.float32)
    return v


def _weights_of(batches: Iterator[pa.RecordBatch], *carried: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tv.chunks(batch.column("text"), most=BLOCK):
            w = term_weights(chunk)
            at = np.flatnonzero(w.ravel())
            offsets = np.searchsorted(at, np.arange(len(w) + 1) * TERMS).astype(np.int32)
            terms = pa.ListArray.from_arrays(offsets, pa.array((at % TERMS).astype(np.int32)))
            values = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()[at]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(chunk.first, len(chunk)) for c in carried), terms, values], names=[*carried, "terms", "values"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = 800, label: str = "quality") -> Voters | None:
    """Voters from at most per_label labelled documents of each label, those of docs with the smallest hash of doc_id.

    docs: doc_id, text; labels: doc_id and `label` (0 or 1).  Rows whose doc_id or label is null aren't used.  Of rows that
    repeat a doc_id, those with the smallest hashes of their texts; a document with both labels votes for both.  Only the
    terms of the chosen texts come to the driver, at most TERMS numbers each.  None where nothing is labelled.
    """
    known = narrow(labels, doc_id="doc_id", label=label).where("doc_id is not null and label in (0, 1)").distinct()
    known = known.join(narrow(docs, doc_id="doc_id"), "doc_id", "left_semi")  # so that labels of other documents take no place
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = narrow(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")  # 2 * per_label rows at most
    order = ["id_hash", "doc_id", "label", "text_hash"]
    texts = texts.select("doc_id", F.col("label").cast("int").alias("label"), "text", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(tv.lean(lambda b: _weights_of(b, *order)), f"id_hash long, doc_id {kind}, label int, text_hash long, terms array<int>, values array<float>")
    rows = rows.orderBy(*order).limit(2 * per_label).toArrow()
    if not len(rows):
        return None
    weights = np.zeros((len(rows), TERMS), np.float32)
    for i, (t, v) in enumerate(zip(rows.column("terms"), rows.column("values"), strict=True)):
        weights[i, t.values.to_numpy()] = v.values.to_numpy()
    return voters(weights, np.asarray(rows.column("label")))


def annotate(docs: DataFrame, model: Voters | None, threshold: float = 0.3) -> DataFrame:
    """All columns of docs (text among them, none of them score or predicted), score and predicted.

    A null text and one without words have the score that the model learned for those; without a model every score is 0.
    Equal rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column("text"), most=BLOCK):
                score = sent.value.score(term_weights(chunk)) if sent.value else np.zeros(len(chunk))
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(tv.lean(run), T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(docs: DataFrame, model: Voters | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of each document; other columns of docs than doc_id and text are left out."""
    return annotate(narrow(docs, doc_id="doc_id", text="text"), model, threshold).select("doc_id", "score", "predicted")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all `documents`; see `train` and `annotate` for nulls, repeated rows and empty tables."""
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held), read(spark, sf_dir, "labels").where(~held))
    return classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
