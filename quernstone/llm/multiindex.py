"""MinHash near-duplicates by a multi-index Hamming join.

A document's distinct word shingles give a signature of CHUNKS x WIDE places, each the lowest 16 bits of a minimum under a
hash of its own (b-bit MinHash); places of two documents agree with a probability that is at least their similarity.  The
distance of two signatures is the number of places that differ.  Signatures are cut into chunks; by pigeonhole two of a
distance below CHUNKS * (ERRORS + 1) have a chunk with at most ERRORS errors.  Which places of a chunk are wrong is
enumerated: a text is entered under what is left of each chunk without any ERRORS of its places, so all pairs within
GUARANTEED share a key.  At similarity 0.8 a chunk has at most one error in 74 of 100 cases, so that no chunk of 14 has is a
matter of 8 pairs in 10^9.  Candidates are pairs within NEAR, which less than one such pair in 10^8 is not, whose parity
sketches leave the similarity possible; sets are compared in full.

The keys are plain rows: a group's hub is its smallest member, by partial minima, and members meet the hubs by a join that
Spark splits where a key is hot.  From there on links are found as in the parity join: hubs first, then what is left between
different components, in cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .columns import narrow, read
from .parityjoin import dense_sketches, fingerprints, fits, joined, shingle_sets, sketches
from .storage import Shelf

CHUNKS, WIDE, ERRORS = 14, 5, 1
PLACES = CHUNKS * WIDE
GUARANTEED, NEAR = CHUNKS * (ERRORS + 1) - 1, 36
_FACTORS = np.random.default_rng(20240301).integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(20240302).integers(0, 1 << 63, PLACES, dtype=np.uint64)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of PLACES 16-bit numbers for each set; zeros for an empty one."""
    out = np.zeros((len(offsets) - 1, PLACES), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for place in range(PLACES):
            least = np.minimum.reduceat(hashes * _FACTORS[place] + _SHIFTS[place], offsets[full])
            out[full, place] = tv.mix(least) & np.uint64(0xFFFF)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of each signature: of every chunk without any ERRORS of its places."""
    x = signature.reshape(-1, CHUNKS, WIDE).astype(np.uint64)
    keys = []
    for chunk in range(CHUNKS):
        for i, left in enumerate(combinations(range(WIDE), WIDE - ERRORS)):
            key = np.full(len(x), chunk * 64 + i + 1, np.uint64)
            for place in left:
                key = tv.mix(key + x[:, chunk, place])
            keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x.view(np.uint16) != y.view(np.uint16)).sum(-1)


def near(na, nb, sa, sb, percent: int):
    """Whether signatures are within NEAR, and sizes and parity sketches leave the similarity possible."""
    cut = 2 * PLACES
    parity = [np.ascontiguousarray(s[..., cut:]) for s in (sa, sb)]
    return (distances(*(np.ascontiguousarray(s[..., :cut]) for s in (sa, sb))) <= NEAR) & fits(na, nb, *parity, percent)


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, fp, sketch (signature and parity sketch) of each row; fp is null for a text without words and for a null doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column("text")):
                hashes, offsets = shingle_sets(chunk, width)
                ids, n = batch.column("doc_id").slice(chunk.first, len(chunk)), np.diff(offsets)
                none = (n == 0) | ids.is_null().to_numpy(zero_copy_only=False)
                both = np.concatenate([signatures(hashes, offsets).view(np.uint8), dense_sketches(hashes, offsets)], axis=1)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(both.shape[1]), len(chunk), [None, pa.py_buffer(both)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(fingerprints(hashes, offsets), mask=none), sketch], names=["doc_id", "n", "fp", "sketch"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, fp long, sketch binary")


def keyed(sets: DataFrame) -> DataFrame:
    """key, fp: each set under its chunk keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = chunk_keys(np.ascontiguousarray(sketches(batch.column("sketch"))[:, : 2 * PLACES]).view(np.uint16))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("fp"), lists], names=["fp", "keys"])

    return sets.select("fp", "sketch").mapInArrow(run, "fp long, keys array<long>").select(F.explode("keys").alias("key"), "fp")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    docs: doc_id (a whole number), text; other columns are left out.  Words are runs of bytes other than white space, with
    A-Z in lower case; a text of fewer than `width` words is one shingle.  Documents are linked when 100 * intersection >=
    percent * union of their distinct shingles; component_id is the smallest doc_id reachable and kept says whether it is the
    document's own.  A text without words, a null text and a row with a null doc_id (kept: null) are linked with nothing.
    Rows that repeat a doc_id stay.  An empty table gives no rows.  NEAR and the keys are meant for 80 percent and more.
    """
    docs = narrow(docs, doc_id="doc_id", text="text")
    found, keep = Shelf(docs.sparkSession, "multiindex"), Shelf(docs.sparkSession, "multiindex-steps")
    rows = found(summaries(docs, width), "documents")
    sets = keep(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "distinct")
    entries = keep(keyed(sets), "entries")
    hubs = entries.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    groups = keep(entries.join(hubs, "key").select("hub", "fp").distinct(), "groups")
    return joined(docs, rows, sets, groups, width, percent, found, keep, near).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all `documents` by two-word shingles; see `near_duplicates` for nulls, ties and repeats."""
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op12_minhash_dedup": op12_minhash_dedup}
