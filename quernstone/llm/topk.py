"""Exact top-k by inner product with multi-resolution segment statistics.

A vector's components are cut into segments.  With the mean and the deviation of each segment of a query q and a
vector x, |q - x|^2 is at least the sum over segments of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), so
(q, x) = (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most the inner product of the statistics, weighed by the lengths.

Vectors lie in blocks, those near the same one of a few sampled vectors together, and of a block the ranges of its
statistics are known.  A query first visits the block that its own nearest sampled vector has; its k-th best product
there is a floor.  Then it visits only the blocks whose ranges allow a product at the floor, so whole blocks are left out
before anything moves.  In a block, bounds are computed with few segments first and more for what is left, and exact
products only for the survivors.  Blocks and the queries that meet in them are of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .columns import narrow, read
from .storage import kept

LEVELS = (1, 4, 16)
QUERY_BLOCK, VECTOR_BLOCK = 4_096, 4_096
ANCHORS, PAGE = 1_024, 4_096


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Root of the length times mean, and times deviation, of each segment; inner products of rows bound those of x."""
    d = x.shape[1]
    cuts = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        mean = x[:, a:b].mean(1)
        out += [math.sqrt(b - a) * mean, np.sqrt(((x[:, a:b] - mean[:, None]) ** 2).sum(1))]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, levels=LEVELS, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector index, product) of each query's k best; ties go to the smaller id; x_ids rise."""
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    stats = [(statistics(qf, s), statistics(xf, s)) for s in levels]
    exact_floats = np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0) * max(q.shape[1], 1) < 2**52
    found = ([], [], [])
    for a in range(0, len(q), step):
        rows = np.arange(a, min(a + step, len(q)))
        own = q_ids[rows][:, None] == x_ids[None, :]
        alive = ~own
        need = np.full(len(rows), -np.inf)
        for sq, sx in stats:
            if alive.mean() > 0.1:
                bound = sq[rows] @ sx.T
                bound[~alive] = -np.inf
            else:
                i, j = np.nonzero(alive)
                bound = np.full(alive.shape, -np.inf)
                bound[i, j] = np.einsum("ij,ij->i", sq[rows][i], sx[j])
            slack = 1e-9 * (np.abs(bound, where=np.isfinite(bound), out=np.zeros_like(bound)) + 1)
            if k < len(x):  # exact products of those that look best give a floor
                seeds = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                scores = np.einsum("ij,ikj->ik", q[rows], x[seeds]).astype(float)
                scores[~np.take_along_axis(~own, seeds, 1)] = -np.inf
                need = np.maximum(need, scores.min(1))
            alive &= bound + slack >= need[:, None]
        i, j = np.nonzero(alive)
        if exact_floats and len(i) > 0.1 * alive.size:
            product = np.rint(qf[rows] @ xf.T).astype(np.int64)[i, j]
        else:
            product = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[rows][i[c : c + 65536]], x[j[c : c + 65536]]) for c in range(0, len(i), 65536))])
        order = np.lexsort((j, -product, i))
        i, j, product = i[order], j[order], product[order]
        starts = np.searchsorted(i, np.arange(len(rows)))
        top = np.arange(len(i)) - starts[i] < k
        for got, part in zip(found, (rows[i[top]], j[top], product[top]), strict=True):
            got.append(part)
    return tuple(np.concatenate([np.zeros(0, np.int64), *f]) for f in found)


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(table), 0), np.int64)


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, v: floor(scale * component); vectors that are null, or hold nulls or numbers that aren't finite, go."""
    x = narrow(vectors, vec_id="vec_id", e="embedding")
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return x.where(F.col("e").isNotNull() & fine & F.col("vec_id").isNotNull()).select("vec_id", F.transform("e", lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def _placed(rows: DataFrame, anchors: np.ndarray, dim: int) -> DataFrame:
    """Adds dim, anchor (the nearest sampled vector; 0 for vectors of another length than theirs) and stats."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors.astype(np.float64))  # at most ANCHORS vectors
    finest = LEVELS[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for batch in batches:
            column = batch.column("v")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            anchor, stats = np.zeros(len(batch), np.int32), np.zeros((len(batch), 2 * finest))
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d).astype(np.float64)
                if d:
                    found = statistics(x, finest)
                    stats[at, : found.shape[1]] = found
                if d == dim and len(a):
                    anchor[at] = (2 * x @ a.T - (a**2).sum(1)).argmax(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * 2 * finest), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(anchor), lists], names=[*batch.schema.names, "dim", "anchor", "stats"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, *T.StructType.fromDDL("dim int, anchor int, stats array<double>")]))


BLOCK = ["dim", "anchor", "part"]


def _visited(q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """row, query_id, vec_id, score of the k best of each block for each query sent to it; both sides have BLOCK columns.

    Where more than QUERY_BLOCK queries come to a block, its vectors meet them in several rounds.
    """
    rounds = q.groupBy(*BLOCK).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("rounds"))
    q = q.join(rounds, BLOCK).withColumn("round", F.pmod(F.xxhash64("row"), F.col("rounds")).cast("int"))
    x = x.join(rounds, BLOCK).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        right = right.sort_by("vec_id")
        dim = key[0].as_py()
        ids, x_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        i, j, score = best(_matrix(left, dim), ids, _matrix(right, dim), x_ids, k)
        return pa.table([pa.array(c) for c in (left.column("row").to_numpy()[i], ids[i], x_ids[j], score)], names=names)

    cell = [*BLOCK, "round"]
    return q.select(*cell, "row", "vec_id", "v").groupBy(*cell).cogroup(x.select(*cell, "vec_id", "v").groupBy(*cell)).applyInArrow(meet, "row long, query_id long, vec_id long, score long")


def _allowed(q: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """row and BLOCK of the blocks that may hold a product at a query's floor.  q: row, dim, stats, floor; blocks: BLOCK,
    lo, hi (ranges of the statistics).  Blocks lie in pages of about PAGE; each query is compared with each page."""
    pages = max(1, math.ceil(n_blocks / PAGE))
    q = q.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).withColumn("share", F.pmod(F.xxhash64("row"), F.lit(64)).cast("int"))
    blocks = blocks.withColumn("page", F.pmod(F.xxhash64(*BLOCK), F.lit(pages)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(63))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names, found = ["row", *BLOCK], []
        if len(left) and len(right):
            matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            s, lo, hi = matrix(left, "stats"), matrix(right, "lo"), matrix(right, "hi")
            floor, rows = left.column("floor").to_numpy(), left.column("row").to_numpy()
            for a in range(0, len(s), 256):
                part = s[a : a + 256]
                up = np.maximum(part, 0) @ hi.T + np.minimum(part, 0) @ lo.T
                i, j = np.nonzero(up + 1e-9 * (np.abs(up) + 1) >= floor[a : a + 256, None])
                found.append(pa.table([pa.array(rows[a + i]), *(right.column(c).take(pa.array(j)) for c in BLOCK)], names=names))
        return pa.concat_tables(found) if found else pa.table({"row": pa.array([], pa.int64()), **{c: pa.array([], pa.int32()) for c in BLOCK}})

    keys = ["dim", "page", "share"]
    return q.select(*keys, "row", "stats", "floor").groupBy(*keys).cogroup(blocks.select(*keys, "anchor", "part", "lo", "hi").groupBy(*keys)).applyInArrow(run, "row long, dim int, anchor int, part int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query row with vectors of its length.

    Both tables: vec_id long, v array<long>.  Vectors with the query's own vec_id take no part; other repeated rows all
    do, and a repeated query row has results of its own.  Ties go to the smaller vec_id.  Products must fit a long.
    The sampled vectors are those with the smallest hashes, one for each VECTOR_BLOCK vectors and at most ANCHORS; larger
    groups are cut by hash.  They only decide what lies together, never the result.  Tables that fit one block have no
    others to leave out.
    """
    order = W.Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    n_x = vectors.count()
    if n_x <= VECTOR_BLOCK:
        one = lambda rows: rows.withColumns({"dim": F.size("v"), "anchor": F.lit(0), "part": F.lit(0)})
        q = kept(one(queries).withColumn("row", F.monotonically_increasing_id()), "topk-queries")
        return ranked(_visited(q, one(vectors), k)).select("query_id", "rank", "vec_id", "score")
    sampled = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(ANCHORS, math.ceil(n_x / VECTOR_BLOCK))).select("v").toArrow().column("v")
    lengths = sampled.combine_chunks().value_lengths().to_numpy()
    dim = int(np.bincount(lengths).argmax())
    anchors = sampled.filter(pa.array(lengths == dim)).combine_chunks().flatten().to_numpy().reshape(-1, dim)
    x = kept(_placed(vectors, anchors, dim), "topk-vectors")
    sizes = x.groupBy("dim", "anchor").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("parts"))
    sizes = kept(sizes, "topk-sizes")  # a row an anchor and length
    x = x.join(sizes, ["dim", "anchor"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")).drop("parts")
    x = kept(x, "topk-blocks")
    edges = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(2 * LEVELS[-1]) for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = x.groupBy(*BLOCK).agg(*edges).select(*BLOCK, *(F.array(*(f"{n}{i}" for i in range(2 * LEVELS[-1]))).alias(n) for n in ("lo", "hi")))
    blocks = kept(blocks, "topk-ranges")
    q = kept(_placed(queries, anchors, dim).withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    near = kept(ranked(_visited(q.withColumn("part", F.lit(0)), x, k)), "topk-near")
    floors = near.groupBy("row").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).cast("double").alias("floor"))
    asked = q.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = _allowed(asked, blocks, blocks.count()).join(q.select("row", "anchor").withColumn("part", F.lit(0)), ["row", "anchor", "part"], "left_anti")
    more = kept(more, "topk-visits")
    rest = _visited(more.join(q.select("row", "vec_id", "v"), "row"), x, k)
    return ranked(near.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all `embeddings` for every fiftieth; see `top_k` for ties, repeated rows and empty tables, `whole_vectors` for nulls."""
    vectors = whole_vectors(read(spark, sf_dir, "embeddings"), 256.0)
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE_SQL = {
    "op4_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op4_topk": op4_topk}
