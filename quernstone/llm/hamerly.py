"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector keeps an upper bound of its distance to its own centroid and one lower bound of that to its second nearest.
When centroids move, the upper bound grows by the own centroid's drift and the lower one shrinks by the largest drift of the
others.  A vector whose upper bound lies below its lower one, or below half of the way from its centroid to the next, stays;
else its own distance is computed anew, and if that doesn't settle it, a full scan in exact integers does.  Bounds are floats
with slack and decide only what is scanned, so clusters and ties are those of plain integer scans.

The state (vectors, clusters, bounds) is a table in the shared folder, one a round; the one before the last goes.  Sums of a
cluster change only by the vectors that moved: tasks add them up and send a row a cluster, so no cluster is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import read
from .storage import drop, kept, shared_dir, stored
from .topk import whole_vectors

SLACK = 1e-9
LARGEST = 1 << 27


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c; all integers below 2^53 in between are exact in floats."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 2**53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return np.rint((xf**2).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf**2).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equally near ones), distance to it and to the second nearest."""
    d = squares(x, c)
    nearest = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, nearest].astype(np.float64))
    d[rows, nearest] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64)) if c.shape[0] > 1 else np.full(len(x), np.inf)
    return nearest, upper, lower


def settle(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds of one batch after centroids moved from `before` to `c`, and how many vectors were scanned."""
    drift = np.sqrt(((c - before) ** 2).sum(1).astype(np.float64))
    far, second = int(drift.argmax()), np.partition(drift, -2)[-2] if len(drift) > 1 else 0.0
    upper = (upper + drift[own]) * (1 + SLACK)
    lower = (lower - np.where(own == far, second, drift[far])) * (1 - SLACK)
    between = squares(c, c).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    half = np.sqrt(between.min(1)) / 2 * (1 - SLACK)
    floor = np.maximum(lower, half[own])
    open_ = np.flatnonzero(~(upper < floor))
    tight = np.sqrt(((x[open_] - c[own[open_]]) ** 2).sum(1).astype(np.float64))
    upper[open_] = tight
    open_ = open_[~(tight * (1 + SLACK) < floor[open_])]
    own = own.copy()
    if len(open_):
        own[open_], upper[open_], lower[open_] = scan(x[open_], c)
    return own, upper, lower, len(open_)


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, out: T.StructType) -> DataFrame:
    """rows with cluster, was (the cluster before, -1 in the first round), upper and lower."""
    sent = rows.sparkSession.sparkContext.broadcast((centroids, before))  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, old = sent.value
        for batch in batches:
            x = matrix(batch.column("v"), c.shape[1])
            if np.abs(x).max(initial=0) >= LARGEST:
                raise ValueError("components beyond 2^27 would let squared distances leave a long")
            if old is None:
                own, upper, lower = scan(x, c)
                was = np.full(len(x), -1)
            else:
                was = batch.column("cluster").to_numpy().astype(np.int64)
                own, upper, lower, _ = settle(x, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), old, c)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, out)


def _moves(state: DataFrame, k: int, dim: int) -> DataFrame:
    """cluster, n, sums: what the vectors that moved add to and take from each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            for name, sign in (("cluster", 1), ("was", -1)):
                to = batch.column(name).to_numpy()
                at = np.flatnonzero(to >= 0)
                np.add.at(n, to[at], sign)
                order = at[np.argsort(to[at], kind="stable")]
                if len(order):
                    starts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1]))
                    sums[to[order][starts]] += sign * np.add.reduceat(x[order], starts, axis=0)
        at = np.flatnonzero((n != 0) | sums.any(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(sums[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), lists], names=["cluster", "n", "sums"])

    parts = state.where("cluster <> was").select("cluster", "was", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector.

    vectors: vec_id, v array<long>, of which those of `dim` components below 2^27 in size take part (larger ones raise).
    The first centroids are the k vectors (all, if fewer) with the smallest sha256 of `salt:vec_id`, a null vec_id counting
    as an empty text, equal ones by their components; repeated rows are vectors of their own.  After the rounds (nearest
    centroid, ties to the smaller number; then floored means, empty clusters stay) all are assigned once more.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.size("v") == dim).select("vec_id", "v")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = rows.orderBy(name, "v").limit(k).select("v").toArrow().column("v")  # at most k vectors
    centroids = matrix(seeds.combine_chunks(), dim).astype(np.int64)
    k = len(centroids)
    id_type = rows.schema["vec_id"].dataType
    kind = T.StructType([T.StructField("vec_id", id_type), *T.StructType.fromDDL("v array<long>, cluster int, was int, upper double, lower double")])
    if not k:
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    n, sums, before, root, path = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), None, shared_dir(spark, "hamerly"), None
    state = rows
    for step in range(rounds + 1):
        last_path, path = path, f"{root}/{step}"
        state = stored(_assigned(state, centroids, before, kind), path)
        if last_path:
            drop(spark, last_path)
        if step < rounds:
            for r in _moves(state, k, dim).toLocalIterator():  # a row a cluster
                n[r.cluster] += r.n
                sums[r.cluster] += np.array(r.sums, np.int64)
            before, centroids = centroids, np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
    measured = _measured(state, centroids)
    totals = kept(measured.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")), "hamerly-totals")
    whole = totals.agg(F.sum("cluster_inertia")).first()[0]
    hashes = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    about = F.broadcast(totals.join(hashes, "cluster").withColumn("inertia", F.lit(whole).cast("long")))  # k rows
    return measured.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance: the exact square of the distance to the own centroid."""
    sent = state.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = matrix(batch.column("v"), c.shape[1])
            distance = ((x - c[batch.column("cluster").to_numpy()]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "cluster", "v").mapInArrow(run, T.StructType([state.schema["vec_id"], *T.StructType.fromDDL("cluster int, distance long")]))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all 64-component `embeddings`; vectors that are null or hold nulls or numbers that aren't finite, and
    those of other lengths, take no part; see `cluster` for ties, repeats and empty tables."""
    return cluster(whole_vectors(read(spark, sf_dir, "embeddings"), 256.0))


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The plain rounds: all distances, then floored means."""
    near = "SELECT row, vec_id, v, arg_min(i, d * 64 + i) AS cluster, min(d) AS distance FROM (SELECT row, vec_id, v.v AS v, i, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {c} c) GROUP BY row, vec_id, v"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS i, v FROM (SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        steps.append(f"s{r} AS (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{r}) GROUP BY cluster, j)")
        steps.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{r} GROUP BY cluster)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT i, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON cluster = i)")
    steps.append(f"a AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return f"WITH {', '.join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a JOIN c{rounds} ON i = cluster"


ORACLE_SQL = {"op13_centroids": _sql()}
QUERIES = {"op13_centroids": op13_centroids}
