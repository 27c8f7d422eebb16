"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens.  A queue of weight w gains credit w a round, spends one for each
token, and carries what is left over.  Played with infinitely small rounds this serves a queue's k-th token at the time
(k + 0.5) / w, so the state after any number of tokens has a closed form: a window's share of each queue can be told in
any task without the windows before it, and the deficits carry over windows and partitions by themselves.  A queue that
has run dry leaves the round, as in the serial algorithm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import textvec as tv
from .bpe import encode_column
from .columns import narrow, read
from .storage import kept

BROADCAST_ROWS = 1_000_000
#: Numbers that the table of windows and queues of a slice of documents may have, and its tokens.
SLICE_CELLS, SLICE_TOKENS = 1_000_000, 1_500_000


class Schedule:
    """How many tokens of each queue are among the first `position` ones."""

    def __init__(self, sizes: np.ndarray, weights: np.ndarray):
        self.sizes, self.weights = sizes.astype(np.int64), weights.astype(np.float64)
        ends = self.sizes / self.weights
        self.shares = self.weights / self.weights.sum()  # the least share that a queue has of a round while it isn't dry
        order = np.argsort(ends, kind="stable")
        self.times = np.concatenate([[0.0], ends[order]])
        dry, left = np.cumsum(self.sizes[order]), np.cumsum(self.weights[order][::-1])[::-1]  # tokens of queues run dry, weights of the others
        self.served = np.concatenate([[0.0], dry + self.times[1:] * np.append(left[1:], 0.0)])
        self._ends, self._dry, self._left = self.times[1:], np.append(0, dry), np.append(left, 0.0)

    def served_at(self, t: np.ndarray) -> np.ndarray:
        """Tokens of all queues at times, as if they could be cut."""
        k = np.searchsorted(self._ends, t, "right")
        return self._dry[k] + t * self._left[k]

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """One row a position, one column a queue: the queue's tokens among the first ones by time, equal times by queue.

        Rounding each queue's tokens at one time gives nearly all; the rest are added or taken by order of time in one go, and
        what that got wrong is swapped.
        """
        t = np.interp(positions, self.served, self.times)[:, None]
        got = np.clip(np.floor(t * self.weights + 0.5), 0, self.sizes).astype(np.int64)
        n, rows = len(self.sizes), np.arange(len(got))
        for _ in range(4 * n + 4):
            off = positions - got.sum(1)
            late = np.where(got > 0, (got - 0.5) / self.weights, -np.inf)
            soon = np.where(got < self.sizes, (got + 0.5) / self.weights, np.inf)
            last, first = n - 1 - late[:, ::-1].argmax(1), soon.argmin(1)
            a, b = late[rows, last], soon[rows, first]
            wrong = np.flatnonzero((off == 0) & ((a > b) | ((a == b) & (last > first) & np.isfinite(a))))
            if not (off.any() or len(wrong)):
                return got
            got[wrong, last[wrong]] -= 1
            got[wrong, first[wrong]] += 1
            for i in np.flatnonzero(off):
                few = min(abs(off[i]), n)
                if off[i] > 0:
                    ready = np.argsort(soon[i], kind="stable")[:few]
                    got[i, ready[np.isfinite(soon[i, ready])]] += 1
                else:
                    ready = n - 1 - np.argsort(-late[i, ::-1], kind="stable")[:few]
                    got[i, ready[np.isfinite(late[i, ready])]] -= 1
        raise ArithmeticError("no schedule found")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, source, part, at, n, ids of each document, kept in the shared folder.

    ids: little-endian unsigned numbers, of 16 bits where none of a chunk's ids is above 65,535 and of 32 bits elsewhere;
    part and at: the task, and the tokens of the same source before this document in that task.
    """
    docs = narrow(docs, doc_id="doc_id", text="text", source="source").withColumn("source", F.col("source").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, served = TaskContext.get().partitionId(), {}
        for batch in batches:
            for chunk, ids, offsets in encode_column(batch.column("text"), tokenizer):
                n = len(chunk)
                lengths = np.diff(offsets) + 1
                kind = np.dtype("<u2" if max(int(ids.max(initial=0)), end_id) < 1 << 16 else "<u4")
                out = np.full(len(ids) + n, end_id, kind)
                mask = np.ones(len(out), bool)
                mask[np.cumsum(lengths) - 1] = False
                out[mask] = ids
                column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(kind.itemsize * lengths)]).astype(np.int32)), pa.py_buffer(out)])
                sources, at = batch.column("source").slice(chunk.first, n), []
                for s, k in zip(sources.to_pylist(), lengths.tolist(), strict=True):
                    at.append(served.get(s, 0))
                    served[s] = at[-1] + k
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, n), sources, pa.array(np.full(n, part, np.int32)), pa.array(at, pa.int64()), pa.array(lengths, pa.int64()), column], names=["doc_id", "source", "part", "at", "n", "ids"])

    return kept(docs.mapInArrow(tv.lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, part int, at long, n long, ids binary"), "pack-ids")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, weights: dict | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    docs: doc_id, text, source; other columns are left out.  A null or empty text is the end id alone; the null source
    is a queue of its own.  weights: target proportion by source (missing: 1), or None for the proportions of the whole
    input, with which all queues run dry together.  All sequences but the last have `length` tokens; the last ones have
    powers of two, so nothing is padding.  Equal rows are packed each.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, end_id)
    per_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sizes = {r[0]: r[1] for r in per_part.groupBy("source").agg(F.sum("n")).collect()}  # one row a source
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(sizes.values())
    size = np.array([sizes[s] for s in names], np.int64)
    plan = Schedule(size, size if weights is None else np.array([weights.get(s, 1.0) for s in names])) if names else None
    number = {s: i for i, s in enumerate(names)}
    tail, tails = total // length * length, []
    for bit in reversed(range(length.bit_length())):
        if (total - tail) >> bit & 1:
            tails.append(1 << bit)
    borders = np.array([tail, *(tail + np.cumsum(tails))], np.int64)

    running = W.Window.partitionBy("source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    base = per_part.withColumn("base", F.coalesce(F.sum("n").over(running), F.lit(0))).select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    base = kept(base, "pack-base")
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue = np.array([number[s] for s in batch.column("source").to_pylist()], np.int64)
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            # tokens of the mixture that a document spans, for the size of its table of windows and queues
            cells = np.minimum((n / plan.shares[queue]) / length + 2, total // length + 2) * len(names)
            weight = np.cumsum(np.maximum(cells / SLICE_CELLS, n / SLICE_TOKENS))
            done = 0
            while done < len(at):  # slices of bounded memory; a longer document is one by itself
                upto = max(done + 1, int(np.searchsorted(weight, (weight[done - 1] if done else 0) + 1, "right")))
                yield _pieces(batch.slice(done, upto - done), queue[done:upto], at[done:upto], n[done:upto], plan, total, length, tail, borders)
                done = upto

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(tv.lean(run), f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _pieces(batch: pa.RecordBatch, queue, at, n, plan: Schedule, total: int, length: int, tail: int, borders: np.ndarray) -> pa.RecordBatch:
    ends = at + n
    w_all, w_per = total // length + 1, length  # window numbers that can hold a token
    # first window of a queue's token: bisection over windows, all documents at once
    def window(position: np.ndarray, q: np.ndarray) -> np.ndarray:
        guess = np.zeros(len(position), np.int64)
        t = (position + 0.5) / plan.weights[q]
        guess = np.clip((plan.served_at(t) // w_per).astype(np.int64), 0, w_all - 1)
        step = 2 + len(plan.sizes) // w_per
        lo, hi = np.maximum(guess - step, 0), np.minimum(guess + step, w_all - 1)
        while (lo < hi).any():  # the last window whose beginning isn't past the position
            mid = (lo + hi + 1) // 2
            begun = plan.counts(np.minimum(mid * w_per, total))[np.arange(len(q)), q] <= position
            lo, hi = np.where(begun, mid, lo), np.where(begun, hi, mid - 1)
        return lo

    first, last = window(at, queue), window(ends - 1, queue)
    spread = last - first + 1
    owner = np.repeat(np.arange(len(at)), spread)
    w = np.repeat(first, spread) + np.arange(len(owner)) - np.repeat(np.cumsum(spread) - spread, spread)
    distinct = np.unique(np.concatenate([w, w + 1]))
    edge = np.minimum(distinct * length, total)
    counts = np.concatenate([plan.counts(edge[i : i + 20_000]) for i in range(0, len(edge), 20_000)])  # a row a border of windows
    earlier = np.cumsum(counts, 1) - counts  # tokens of the queues before each one
    q, here = queue[owner], np.searchsorted(distinct, w)
    low, high = counts[here, q], counts[here + 1, q]
    before = earlier[here + 1, q] - earlier[here, q]  # the window's tokens of the queues before
    begin, end = np.maximum(low, at[owner]), np.minimum(high, ends[owner])
    offset = before + begin - low
    full = end > begin
    owner, w, begin, end, offset = owner[full], w[full], begin[full], end[full], offset[full]
    sequence = w
    if len(borders) > 1 and (w * length >= tail).any():  # the rest goes to sequences of a power of two each
        place = w * length + offset
        inner = borders[1:-1]
        cut = [(o, s, b, e, p) for o, s, b, e, p in zip(owner, w, begin, end, place, strict=True) if p >= tail]
        keep = place < tail
        rows = []
        for o, s, b, e, p in cut:
            for x in [*inner[(inner > p) & (inner < p + e - b)], p + e - b]:
                k = int(np.searchsorted(borders, p, "right")) - 1
                rows.append((o, tail // length + k, b, b + x - p, p - borders[k]))
                b, p = b + x - p, x
        more = np.array(rows, np.int64).reshape(-1, 5)
        owner, sequence, begin, end, offset = (np.concatenate([a[keep], m]) for a, m in zip((owner, w, begin, end, offset), more.T, strict=True))
    start, size = begin - at[owner], end - begin
    ids, ids_at = _numbers(batch.column("ids"), n)
    view = memoryview(ids.view(np.uint8))
    a = (ids_at[owner] + start) * 4
    crc = np.fromiter((zlib.crc32(view[i:j]) for i, j in zip(a.tolist(), (a + 4 * size).tolist(), strict=True)), np.int64, len(a))
    take = pa.array(owner)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("source").take(take), *(pa.array(x.astype(np.int64)) for x in (start, size, crc, n[owner], sequence, offset))], names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _numbers(column: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of documents with n ids each, as 32-bit numbers, and where each document's begin."""
    data, offsets = tv.buffers(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts = np.cumsum(n) - n
    wide = np.diff(offsets) == 4 * n
    if not wide.any():
        return data.view("<u2").astype("<u4"), starts
    if wide.all():
        return data.view("<u4"), starts
    return np.concatenate([data[a:b].view("<u4" if w else "<u2").astype("<u4") for a, b, w in zip(offsets, offsets[1:], wide, strict=False)]), starts


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all `documents`; see `pack` for nulls, repeated rows and empty tables."""
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op10_packing": op10_packing}
