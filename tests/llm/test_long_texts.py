"""Texts longer than a chunk of texts (1 MiB), which are a run of their own, through the operators that read texts in chunks."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import katz, langid, packing, parityjoin, quality, rules

from .brute import components, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(6)
LONG = " ".join(RNG.choice(["der", "die", "und", "Straße", "von", "é" * 3]) + (f"{i}" if i % 7 == 0 else "") for i in range(400_000))
NEAR = LONG[200_000:]
TEXTS = [(1, LONG), (2, NEAR), (3, LONG), (4, "kurz und gut"), (5, ""), (6, None), (7, "ein " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(NEAR.encode()) > 2 * (1 << 20)
    return spark.createDataFrame([(*r, "s" if r[0] % 2 else "t", "de") for r in TEXTS], "doc_id long, text string, source string, lang string").repartition(2)


def test_katz(docs):
    got = {r.doc_id: r for r in katz.learn_and_score(docs.withColumn("train", F.col("doc_id") != 4), order=2).rows.collect()}
    assert all(got[i].n_tokens == len(WORD.findall(t or "")) + 1 for i, t in TEXTS)
    assert abs(got[1].score - got[3].score) < 1e-6 * abs(got[1].score) and got[1].n_known == got[1].n_tokens


def test_parity_join(docs):
    sets = {i: shingles(t) for i, t in TEXTS}
    roots = components(sets)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in parityjoin.jaccard_components(docs).collect()} == {(i, len(s), roots[i]) for i, s in sets.items()}


def test_rules(docs):
    got = {r.doc_id: r for r in rules.cascade(docs).collect()}
    for i, t in TEXTS:
        words = WORD.findall(t or "")
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols) == (len(words), sum(map(len, words)), 0)


def test_packing(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.default_tokenizer()
    encoder = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    for i, t in TEXTS:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert pieces[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False)) and pieces[-1][0] + pieces[-1][1] == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in pieces)


def test_models_see_whole_texts(spark, docs, sf):
    """A long text of one language is of that language, and equal texts have equal scores however they lie."""
    corpus = spark.read.parquet(f"{sf}/documents.parquet")
    german = " ".join(r.text for r in corpus.where("lang = 'de'").orderBy("doc_id").select("text").collect())
    german = german * (1 + 3_000_000 // len(german))
    long = spark.createDataFrame([(1, german), (2, german[: 1 << 19]), (3, german)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.annotate(long, langid.train(corpus)).collect()}
    assert {r.lang_pred for r in found.values()} == {"de"}
    model = quality.train(corpus, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.annotate(long, model).collect()}
    assert scores[1] == scores[3] and all(0 <= s <= 1 for s in scores.values())
