import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import multiindex as mi

from .brute import components as brute_components
from .brute import shingles

HERE = "/root/testdata"


def expect(rows, got):
    sets = {i: shingles(t, 2) for i, t in rows}
    roots = brute_components(sets)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(sets[i]), roots[i], roots[i] == i) for i, _ in rows)


def test_op12_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{HERE}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    expect(rows, mi.op12_minhash_dedup(spark, f"{HERE}/sf0.01").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, seed):
    from .test_parityjoin import chains

    rows = chains(random.Random(seed), 25, 24, 4)
    expect(rows, mi.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_a_passage_that_most_texts_hold(spark):
    """Hundreds of different texts that share half of their shingles meet under hot keys and stay apart, copies don't."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"t{i}x{j}" for j in range(55)]) for i in range(300)]
    texts += [t + " end" for t in texts[:40]] + texts[:20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expect(rows, mi.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A\n"), (5, "a b"), (6, "a  B"), (7, "x " * 30_000), (8, "X " * 9), (9, " \t"), (10, "é " * 40), (11, "É " * 40), (12, "b a")]
    rows += [(13, " ".join(f"w{i}" for i in range(300_000))), (14, " ".join(f"w{i}" for i in range(30_000, 300_000)))]  # longer than a chunk of texts
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, fp string")
    expect(rows, mi.near_duplicates(docs).collect())
    assert mi.near_duplicates(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (6, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, bool(r.kept)) for r in mi.near_duplicates(twice).collect())
    assert got == [(0, 0, False), (5, 5, True), (5, 5, True), (6, 5, False)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, mi.GUARANTEED))
def test_signatures_within_the_guarantee_share_a_key(seed, wrong):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 16, (1, mi.PLACES), dtype=np.uint16)
    b = a.copy()
    b[0, rng.permutation(mi.PLACES)[:wrong]] += 1
    assert mi.distances(a[0], b)[0] == wrong
    assert set(mi.chunk_keys(a)[0].tolist()) & set(mi.chunk_keys(b)[0].tolist())


def test_places_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    both = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    a, b = both[:3600], both[400:]
    s = mi.signatures(np.concatenate([a, b]), np.array([0, 3600, 7200]))
    assert abs(1 - mi.distances(s[0], s[1:])[0] / mi.PLACES - 0.8) < 0.15
