import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import hamerly

from ..oracle import compare, connection

HERE = "/root/testdata"


def plain(rows, k=40, rounds=5, salt="2"):
    """rows: (vec_id, list of integers); the rounds as they are told, in Python's integers."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in rows[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for i in range(len(centroids)):
            mine = [v for (_, v), o in zip(rows, own, strict=True) if o == i]
            if mine:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(vec_id, *nearest(v)) for vec_id, v in rows]
    total = sum(d for _, d, _ in last)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(vec_id), i, d, sum(e for _, e, j in last if j == i), total, digest[i]) for vec_id, d, i in last)


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_against_sql(spark, sf):
    assert compare(hamerly.op13_centroids(spark, f"{HERE}/{sf}"), hamerly.ORACLE_SQL["op13_centroids"], connection(f"{HERE}/{sf}")) == ""


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 150, 40), (2, 12, 40), (3, 90, 3), (4, 60, 1)])
def test_against_plain_rounds(spark, seed, n, k):
    """Few different components make many ties; copies leave centroids without vectors."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.integers(-2, 3, 6).tolist()) for i in rng.integers(0, 40, n)]
    rows += [(None, [0] * 6), (None, [0] * 6), (7, [1, 2]), (8, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, v array<long>, cluster string")
    assert rows_of(hamerly.cluster(df.repartition(3), k, 5, 6)) == plain([r for r in rows if len(r[1]) == 6], k)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    odd = [(1, None, 0), (2, [], 0), (3, [0.5] * 63, 0), (4, [0.5] * 63 + [None], 0), (5, [float("nan")] * 64, 0), (6, [float("inf")] * 64, 0)]
    assert hamerly.cluster(hamerly.whole_vectors(spark.createDataFrame(odd, schema), 256.0)).count() == 0
    assert hamerly.cluster(hamerly.whole_vectors(spark.createDataFrame([], schema), 256.0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    one = hamerly.cluster(hamerly.whole_vectors(spark.createDataFrame([*odd, (9, [-0.001] * 64, 1)], schema), 256.0))
    assert rows_of(one) == plain([(9, [-1] * 64)])
    with pytest.raises(Exception, match="2\\^27"):
        hamerly.cluster(hamerly.whole_vectors(spark.createDataFrame([(1, [1e9] * 64, 0)], schema), 256.0)).collect()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.sampled_from([2, 40, 10**7]))
def test_bounds_never_change_a_cluster(seed, k, size):
    """Over rounds of moving centroids, clusters are those of full scans, and far fewer vectors are scanned."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-size, size, (200, 5)), rng.integers(-size, size, (k, 5))
    own, upper, lower = hamerly.scan(x, c)
    for _ in range(4):
        moved = c + rng.integers(-size // 8 - 1, size // 8 + 1, c.shape) * rng.integers(0, 2, (k, 1))
        own, upper, lower, scanned = hamerly.settle(x, own, upper, lower, c, moved)
        c = moved
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x])
        assert (own == exact.argmin(1)).all()
        assert (upper * (1 + 1e-6) + 1e-6 >= np.sqrt(exact[np.arange(200), own])).all()
        assert k == 1 or (lower <= np.sqrt(np.sort(exact, 1)[:, 1]) * (1 + 1e-6) + 1e-6).all()
        assert 0 <= scanned <= 200


def test_few_vectors_are_scanned_once_centroids_settle():
    rng = np.random.default_rng(5)
    middle = rng.integers(-10_000, 10_000, (8, 16))
    x = middle[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 16))
    own, upper, lower = hamerly.scan(x, middle + 5)
    assert hamerly.settle(x, own, upper, lower, middle + 5, middle)[3] < 40
