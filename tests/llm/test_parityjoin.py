import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import components, parityjoin

from .brute import components as brute_components
from .brute import shingles

HERE = "/root/testdata"


def expect(rows, got, percent=80):
    sets = {i: shingles(t) for i, t in rows}
    roots = brute_components(sets, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), roots[i]) for i, _ in rows)


def test_op3_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{HERE}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    expect(rows, parityjoin.op3_jaccard_join(spark, f"{HERE}/sf0.01").collect())


def chains(rng, n_groups, size, edits):
    """Chains of texts, each a few edits away from one before it, so groups hold links of every similarity."""
    rows = []
    for g in range(n_groups):
        texts = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 14, 30, 80, 200]))]]
        for _ in range(size):
            w = list(rng.choice(texts))
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"v{rng.randrange(10_000)}"]
            texts.append(w)
        rows += [" ".join(w) for w in texts]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 80), (3, 60)])
def test_chains_of_near_copies(spark, seed, percent):
    rows = chains(random.Random(seed), 25, 24, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect(rows, parityjoin.jaccard_components(docs, percent=percent).collect(), percent)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B\n"), (5, "a b c d e"), (6, "a b c d e"), (7, "x " * 30_000), (8, "X " * 9), (9, " \t"), (10, "é " * 40), (11, "É " * 40)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, fp string")
    expect(rows, parityjoin.jaccard_components(docs).collect())
    assert parityjoin.jaccard_components(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in parityjoin.jaccard_components(twice).collect())
    assert got == [(0, 0), (5, 5), (5, 5), (6, 5)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([50, 70, 80, 90]))
def test_similar_sets_share_a_key(seed, size, percent):
    """The pigeonhole itself: of random pairs at the threshold, none is without a common key."""
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 1 << 63, size + 60, dtype=np.uint64) * np.uint64(2))
    a = base[:size]
    gone = rng.integers(0, size + 1)
    added = rng.integers(0, 60)
    b = np.sort(np.concatenate([a[gone:], base[size : size + added]]))
    if not len(b):
        return
    shared = size - gone
    hashes, offsets = np.concatenate([np.sort(a), b]), np.array([0, len(a), len(a) + len(b)])
    keys, owner = parityjoin.block_keys(hashes, offsets, percent)
    if 100 * shared >= percent * (len(a) + len(b) - shared):
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    sketch = parityjoin.dense_sketches(hashes, offsets)
    assert parityjoin._distance(sketch[0], sketch[1]) <= len(a) + len(b) - 2 * shared


def test_buckets_with_several_components_are_compared(spark):
    """Groups whose hub is linked with nobody still find the links of the others, in cells too."""
    rng = random.Random(5)
    text = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w)) for i in range(30) for w in [[*text[:20], *(f"u{i // 2}x{j}" for j in range(40))]]]
    docs = spark.createDataFrame([(i, t + (" tail" if rng.random() < 0.5 else "")) for i, t in rows], "doc_id long, text string")
    sets = parityjoin.summaries(docs, 5).where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    fps = sorted(r.fp for r in sets.select("fp").collect())
    groups = spark.createDataFrame([(fps[0], f) for f in fps], "hub long, fp long")
    none = spark.createDataFrame([], "node long, root long")
    for cell in (1024, 4):
        parityjoin.CELL, before = cell, parityjoin.CELL
        try:
            found = parityjoin.left_over(groups, none, sets, 80)
            links = {(r.a, r.b) for r in parityjoin.verified(found, sets, docs, 5, 80).collect()}
        finally:
            parityjoin.CELL = before
        by_fp = {r.fp: shingles(docs.where(f"doc_id = {r.doc}").first().text) for r in sets.collect()}
        want = {(a, b) for a in fps for b in fps if a < b and 100 * len(by_fp[a] & by_fp[b]) >= 80 * len(by_fp[a] | by_fp[b])}
        assert links == want


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    name = [rng.randrange(1 << 40) for _ in range(500)]
    links = [(name[i], name[i + 1]) for i in range(0, 200)] + [(name[300], name[i]) for i in range(301, 400)] + [(name[450], name[450])]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {roots[name[i]] for i in range(201)} == {min(name[:201])} and {roots[name[i]] for i in range(300, 400)} == {min(name[300:400])}
    assert len(roots) == 301
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_members_of_a_large_group_meet_one_hub(spark, monkeypatch):
    """Copies of a text with edits of their own share keys with many others; pairs to be looked at stay near one a copy."""
    rng = random.Random(5)
    base, looked = [f"w{i}" for i in range(150)], []
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 4)):
            w[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    verified = parityjoin.verified

    def counted(pairs, *rest, **more):
        looked.append(pairs.count())
        return verified(pairs, *rest, **more)

    monkeypatch.setattr(parityjoin, "verified", counted)
    expect(rows, parityjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(looked) <= 1.5 * len(rows)


def test_python_gets_small_batches_while_the_join_lasts(spark, monkeypatch):
    key, seen, plain = "spark.sql.execution.arrow.maxBytesPerBatch", [], parityjoin.summaries

    def noted(docs, width):
        seen.append(spark.conf.get(key))
        sizes = docs.mapInArrow(lambda batches: (b.select([0]).slice(0, 1) for b in batches), "doc_id long")
        seen.append(sizes.count())
        return plain(docs, width)

    monkeypatch.setattr(parityjoin, "summaries", noted)
    before = spark.conf.get(key)
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("a b c d e "), F.col("id").cast("string"), F.lit(" ")), 250_000).alias("text")).coalesce(1)
    got = parityjoin.jaccard_components(docs).collect()
    assert seen == ["4194304b", 3] and len(got) == 6
    assert spark.conf.get(key) == before
    with pytest.raises(ValueError, match="stop"):
        monkeypatch.setattr(parityjoin, "summaries", lambda *_: (_ for _ in ()).throw(ValueError("stop")))
        parityjoin.jaccard_components(docs)
    assert spark.conf.get(key) == before


def test_a_task_holds_few_keys_at_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    flushes = parityjoin.entries(docs, 5, 80, 64).groupBy("bucket").count()
    assert flushes.agg(F.min("count")).first()[0] > 1
    many = parityjoin.entries(docs, 5, 80, 1 << 19).where("bucket = 0").count()
    assert many <= 1


def test_sketches_of_long_texts_filter_and_fold(spark):
    """Sets of 6,000 shingles with little in common are told apart, whatever the widths; the bound holds for similar ones."""
    rng = np.random.default_rng(7)
    every = np.unique(rng.integers(0, 1 << 63, 16_000, dtype=np.uint64))
    sets = [np.sort(rng.permutation(every)[:n]) for n in (6_000, 6_400, 7_000, 8_500)]
    sets += [sets[0][600:], np.sort(np.concatenate([sets[2], every[~np.isin(every, sets[2])][:1_500]]))]
    hashes, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    kind, row, each = parityjoin.by_width(parityjoin.sized_sketches(hashes, offsets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(np.intersect1d(a, b))
            fit = parityjoin.fits(len(a), len(b), each[kind[i]][row[i]], each[kind[j]][row[j]], 80)
            assert parityjoin._distance(each[kind[i]][row[i]], each[kind[j]][row[j]]) <= len(a) + len(b) - 2 * shared
            assert fit == (100 * shared >= 80 * (len(a) + len(b) - shared))
    assert len(each) == 2
    few = spark.createDataFrame([(1, "a b c d e"), (2, "w " * 9 + " ".join(f"x{i}" for i in range(3_000)))], "doc_id long, text string")
    assert [len(r.sketch) for r in parityjoin.summaries(few, 5).orderBy("doc_id").collect()] == [32, 1024]


def test_a_text_is_sent_to_the_buckets_of_its_bands(spark):
    """Few bytes a key are shuffled, as a text's fingerprint goes to few buckets."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(int(30 * 1.01 ** (i % 400))))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    shares = parityjoin.bucket_shares(parityjoin.summaries(docs, 5), 80, 2 << 20)
    assert shares.sum() >= 64
    packed = parityjoin.entries(docs, 5, 80, shares).selectExpr("sum(length(fps) + length(counts) + length(keys))", "sum(length(keys)) / 4").first()
    assert packed[0] < 6 * packed[1]  # 8 bytes a key without the fingerprints before


def test_repeated_ids_of_near_copies_are_verified_once(spark):
    text = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(text))] * 3 + [(2, " ".join([*text, "end"]))] * 3 + [(3, "other words " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in parityjoin.jaccard_components(docs).collect()) == [(1, 1)] * 3 + [(2, 1)] * 3 + [(3, 3)]


def families(seed, n_families=150, size=6):
    """Short texts with ends put to copies of copies; some are linked only with a hub that has no other member."""
    rng, rows = random.Random(seed), []
    for g in range(n_families):
        texts = [[f"w{g}_{j}" for j in range(12 + rng.randrange(6))]]
        for _ in range(size):
            w = list(rng.choice(texts))
            for _ in range(rng.randrange(3)):
                w.insert(rng.choice([0, len(w)]), f"v{rng.randrange(10**6)}")
            texts.append(w)
        rows += [" ".join(w) for w in texts]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [8, 12])
def test_a_member_meets_hubs_that_have_no_other_member(spark, seed):
    rows = families(seed)
    expect(rows, parityjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_the_pipeline_drops_copies_of_hubs_that_have_no_other_member(spark):
    import corpus_pipeline as cp

    rows = families(12)
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, HERE).collect())
    roots = brute_components({i: shingles(t) for i, t in rows})
    assert left == sorted(set(roots.values()))
