"""Katz scores against a plain model, quality on held-out labels, templates on small sites, and the pipeline's stages."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import htmltext, katz, langid, quality
from quernstone.llm import textvec as tv

from .brute import WORD, components, lower, shingles

END, BEGIN = "\n", "\r"


def tokens(text):
    return [*WORD.findall(lower(text or "")), END]


class Plain:
    """The model by its definition: a Counter for each order, and the recursion for each token."""

    def __init__(self, texts, order=3, least=(1, 1, 2)):
        self.order, self.least = order, least
        self.count = [Counter() for _ in range(order + 1)]
        for t in texts:
            s = [BEGIN, *tokens(t)]
            self.count[0][()] += len(s) - 1
            self.count[1][(BEGIN,)] += 1
            for j in range(1, len(s)):
                for k in range(1, min(order, j + 1) + 1):
                    self.count[k][tuple(s[j - k + 1 : j + 1])] += 1
        self.uni = {g[0]: c for g, c in self.count[1].items() if g != (BEGIN,)}
        self.n = sum(self.uni.values())
        kinds = lambda counts: np.array([sum(c == r for c in counts) for r in range(1, katz.K + 2)])
        self.d = [None, *(katz.discounts(kinds([c for g, c in self.count[k].items() if g != (BEGIN,)]), least[k - 1]) for k in range(1, order + 1))]
        self.after = defaultdict(list)
        for k in range(2, order + 1):
            for g, c in self.count[k].items():
                if c >= least[k - 1]:
                    self.after[g[:-1]].append(g[-1])
        self.unknown = 1 - sum(self.cut(1, c) for c in self.uni.values()) / self.n

    def cut(self, k, c):
        return self.d[k][c - 1] * c if c <= katz.K else c - katz.TAIL

    def p(self, h, w):
        if not h:
            return self.cut(1, self.uni[w]) / self.n if w in self.uni else self.unknown
        k = len(h) + 1
        c = self.count[k].get((*h, w), 0)
        if c >= self.least[k - 1]:
            return self.cut(k, c) / self.count[len(h)][h]
        if not self.after.get(h):
            return self.p(h[1:], w)
        return (1 - sum(self.p(h, x) for x in self.after[h])) / (1 - sum(self.p(h[1:], x) for x in self.after[h])) * self.p(h[1:], w)

    def score(self, text):
        s = [BEGIN, *tokens(text)]
        return sum(math.log10(self.p(tuple(s[max(0, j - self.order + 1) : j]), s[j])) for j in range(1, len(s)))


@pytest.fixture(scope="module")
def some(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text")


@pytest.mark.parametrize(("order", "least", "batch"), [(3, None, 700), (2, (1, 1), 2_000_000), (4, (1, 1, 1, 1), 900), (1, None, 500)])
def test_katz_against_a_plain_model(spark, some, order, least, batch, monkeypatch):
    """Several batches, a hot bigram, ties, repeated rows, empty, null and very long texts."""
    monkeypatch.setattr(katz, "BATCH_TOKENS", batch)
    monkeypatch.setattr(katz, "LEAST_BUCKETS", 5)
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "Unheard words only"), (903, None), (904, "of the " * 3000), (905, "of the x of the y"), (905, "of the x of the y"), (906, "of the z"), (None, "of the z a b c")], "doc_id long, text string")
    docs = some.unionByName(extra).withColumn("train", F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))).withColumn("score", F.lit("clash")).withColumn("batch", F.lit(1))
    rows = docs.select("doc_id", "text", "train").collect()
    model = Plain([r.text for r in rows if r.train], order, least or katz.default_least(order))
    scored = katz.learn_and_score(docs, order=order, least=least)
    got = defaultdict(list)
    for r in scored.rows.collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    v = len(model.uni)
    for r in rows:
        t = tokens(r.text)
        for x in got[r.doc_id]:
            assert (x.n_tokens, x.n_known) == (len(t), sum(w in model.uni for w in t))
            assert x.base_score == pytest.approx(sum(math.log10((model.uni.get(w, 0) + 0.5) / (model.n + 0.5 * (v + 1))) for w in t), rel=1e-9)
            assert x.score == pytest.approx(model.score(r.text), rel=1e-6)
    want = {k: Counter(c for g, c in model.count[k].items() if g != (BEGIN,) and c >= model.least[k - 1]) for k in range(1, order + 1)}
    assert {k: Counter({r["count"]: r.n_grams for r in scored.ngrams().where(f"n = {k}").groupBy("count").agg(F.count("*").alias("n_grams")).collect()}) for k in want} == want
    assert scored.backoffs().count() == sum(1 for words in model.after.values() if words)


def test_plain_model_is_normalised(some):
    model = Plain([r.text for r in some.limit(10).collect()] + ["of the x of the y of the x"] * 2)
    for h in [(BEGIN,), ("of",), ("of", "the"), *[h for h in model.after if len(h) == 2][:5], ("never", "seen")]:
        assert sum(model.p(h, w) for w in [*model.uni, "<unknown>"]) == pytest.approx(1)


def test_katz_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", False), (None, None, False)], "doc_id long, text string, train boolean")
    assert [r.n_known for r in katz.learn_and_score(docs).rows.collect()] == [0, 0, 0]
    assert katz.learn_and_score(docs.limit(0)).rows.count() == 0


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = quality.op6_quality_classifier(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.quality for r in found)
    kept = [r for r in found if r.quality == 1]
    assert right >= 0.85 * len(found) and sum(r.predicted for r in kept) >= 0.97 * len(kept)


def plain_score(model, text):
    """The vote on one text, term by term and neighbour by neighbour."""
    raw, terms = text.encode(), Counter()
    for x, y in zip(raw, raw[1:], strict=False):
        terms[int(quality.CLASS[x]) * quality.CLASSES + int(quality.CLASS[y])] += 1 / len(raw)
    words = WORD.findall(lower(text))
    if not words:
        return model.empty
    for i, lag in enumerate(quality.LAGS):
        share = sum(a == b for a, b in zip(words, words[lag:], strict=False)) / len(words)
        terms[quality.PAIRS + 2 * i], terms[quality.PAIRS + 2 * i + 1] = share, max(share - 0.1, 0)
    for w in words:
        (chunk,) = tv.chunks(pa.array([w]))
        terms[quality.TERMS - quality.WORDS + (int(tv.words(chunk, lower=True).hashes[0]) >> 40) % quality.WORDS] += 1 / len(words)
    at = sum(math.log1p(1000 * v) * float(model.idf[t]) * model.axes[t].astype(float) for t, v in terms.items())
    at = at / max(np.linalg.norm(at), 1e-12)
    cosines = sorted(((float(at @ v), label) for v, label in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)
    last = cosines[min(model.neighbours, len(cosines)) - 1][0]
    votes = [(max(c, 0) ** model.power + 1e-9, label) for c, label in cosines if c >= last - 1e-5]
    return sum(v * label for v, label in votes) / sum(v for v, _ in votes)


def test_quality_against_a_plain_vote(spark, sf):
    """Repeated rows, conflicting labels, ties among neighbours, null, empty and very long texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    labels = labels.unionByName(labels.limit(5).withColumn("quality", 1 - F.col("quality")))
    model = quality.train(docs.unionByName(docs.limit(9)), labels, per_label=40)
    assert len(model.labels) <= 80 and 0 <= model.empty <= 1
    again = quality.train(docs.limit(9).repartition(3).unionByName(docs.repartition(5)), labels.repartition(2), per_label=40)
    assert np.allclose(model.labels, again.labels) and np.allclose(model.idf, again.idf)
    rows = docs.limit(60).unionByName(docs.limit(2)).collect() + [(9_000, None), (9_001, " \n"), (9_002, "x"), (9_003, "Wörter! " * 40_000)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(plain_score(model, t or ""))
    assert len(got) == len(rows)
    near = [abs(r.score - want[r.doc_id][0]) < 1e-3 for r in got]
    assert sum(near) >= len(near) - 1 and all(r.predicted == (r.score >= 0.3) for r in got)  # single precision may move one border


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", 5), (1, "good text here", 6), (2, None, 7), (3, "", 8), (None, "x", 9)], "doc_id long, text string, score_of int")
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = sorted(tuple(r) for r in quality.classify(docs.where("doc_id is not null"), quality.train(docs, labels)).collect())
    assert len(got) == 4 and got[0] == got[1] and [s for _, s, _ in got] == pytest.approx([1, 1, 1, 1])  # the only labelled text votes
    assert {r.score for r in quality.classify(docs, quality.train(docs.limit(0), labels)).collect()} == {0.0}
    assert quality.classify(docs.limit(0), None).count() == 0
    junk = spark.createDataFrame([(i, "", 0) if i % 2 else (i, f"some longer text about things {i} of note", 1) for i in range(60)], "doc_id long, text string, quality int")
    learned = quality.train(junk, junk.select("doc_id", "quality"))
    assert learned.empty == 0 and {(r.predicted, r.doc_id % 2) for r in quality.classify(junk, learned).collect()} == {(0, 1), (1, 0)}


def test_labels_of_other_documents_take_no_place(spark, sf):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    assert len(quality.train(docs, labels, per_label=2).labels) == 4
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(20).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    assert cp.keep_quality(spark, real, sf).count() == 20


def page(i, body):
    return f"<html><body><nav>menu</nav><div><span>Same banner text on each page</span></div>{body}<div>Imprint of the site</div><footer>end</footer></body></html>"


def test_recurring_subtrees_go(spark):
    pages = [(i, f"http://a.example/{i}", page(i, f"<p>Own &amp; only\n text {i}</p><p>More <b>of</b> it {i}</p>")) for i in range(12)]
    pages += [(100, "http://b.example/x", page(100, "<p>Alone</p>")), (101, None, None), (102, "http://a.example/e", ""), (0, pages[0][1], pages[0][2])]
    got = sorted(tuple(r) for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got[0] == got[1] == (0, "http://a.example/0", "Own & only text 0\nMore of it 0", 30)
    assert [r[2] for r in got if r[0] >= 100] == ["Same banner text on each page\nAlone\nImprint of the site", "", ""]
    assert all(len(r[2]) == r[3] for r in got)


def test_ties_at_the_threshold_and_clashing_columns(spark):
    pages = [(i, f"http://t.example/{i}", f"<div>Own {i}</div>{'<p>ten</p>' if i < 10 else ''}{'<p>nine</p>' if i < 9 else ''}", "mine", 5, "x") for i in range(60)]
    rows = htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int, key string")).collect()
    assert sorted((r.page_id, r.text) for r in rows) == [(i, f"Own {i}" + "\nnine" * (i < 9)) for i in range(60)]
    assert rows[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_comments_forms_and_scripts_go(spark):
    html = "<article><h1>T</h1><p>a<br>b&nbsp;c</p><form>f</form><div class='comments'>x</div><script>var t='</p>'</script><p>last</p></article><aside>s</aside>"
    (r,) = htmltext.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    assert r.text.replace("\n", " ") == "T a b c last"


def texts(spark, pages, **options):
    rows = [(i, *p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect())]


@pytest.mark.parametrize("broadcast_keys", [2_000_000, 0])
def test_copies_count_once_and_template_is_a_share(spark, broadcast_keys):
    pages = [(f"http://c.example/{i}", page(i, "<p>Same story</p>")) for i in range(12)]
    pages += [(f"http://d.example/{i}", f"<body><div>{'<p>Menu</p>'}<article><p>Same story</p></article></div><p>{i}</p>") for i in range(12)]
    pages += [(f"http://e.example/{i}", f"<p>Banner</p><p>Text {i}</p>" + "<p>Yes.</p>" * (i < 12)) for i in range(150)]
    got = texts(spark, pages, broadcast_keys=broadcast_keys)
    assert got[:12] == ["Same banner text on each page\nSame story\nImprint of the site"] * 12
    assert got[12:24] == ["Same story"] * 12
    assert got[24:] == [f"Text {i}" + "\nYes." * (i < 12) for i in range(150)]


def test_template_inside_articles_goes_by_counts(spark):
    box = "<div class='x7'><p>Follow us on all channels</p></div>"
    table = "<table><tr><th>Own {0}</th><td>0</td></tr></table>"
    pages = [(f"http://f.example/{i}", f"<main><article><h1>Title {i}</h1>{box if i % 2 else ''}<p>Text {i}</p>{'<p>Quoted</p>' if i < 12 else ''}{table.format(i)}</article></main>") for i in range(150)]
    pages += [(f"http://g.example/{i}", f"<article>{box}<p>Text {i}</p></article>") for i in range(5)]
    got = texts(spark, pages)
    assert got[:150] == [f"Title {i}\nText {i}\n" + "Quoted\n" * (i < 12) + f"Own {i}\n0" for i in range(150)]
    assert got[150:] == [f"Follow us on all channels\nText {i}" for i in range(5)]


def test_host_counts_against_a_plain_count(spark):
    """Templates by the definition: texts of whole subtrees in a dictionary, by host and different page."""
    rng = random.Random(4)
    blocks = [f"<div class='b{i}'><p>Block {i}</p><ul><li>x{i % 3}</li></ul></div>" for i in range(12)]
    pages = []
    for i in range(90):
        shown = [b for k, b in enumerate(blocks) if rng.random() < (k + 1) / 14]
        article = f"<article><h1>T{i}</h1><p>Own {i}</p>{''.join(rng.sample(blocks, 2))}</article>" if i % 3 else f"<p>Own {i}</p>"
        pages.append((f"http://{'ab'[i % 2]}.example/{i}", f"<body>{''.join(shown)}{article}</body>"))
    pages += pages[:9]
    seen, total = defaultdict(set), defaultdict(set)

    def subtrees(e, inside):
        """Yields (element, its whole text, whether it lies in an article, whether it holds one)."""
        parts, holds = [], False
        for p in e.parts:
            if isinstance(p, str):
                parts.append(" ".join(p.split()))
            else:
                text, has = yield from subtrees(p, inside or e.tag == "article")
                parts.append(text)
                holds |= has or p.tag == "article"
        text = f"<{e.tag}{e.marks}>{'|'.join(x for x in parts if x)}</>"
        yield e, text, inside, holds
        return text, holds

    def found(url, html):
        root, site = htmltext.parse(html), htmltext.host(url)
        articles = "".join(t for e, t, _, _ in subtrees(root, False) if e.tag == "article")
        return root, site, articles, [(e, t, inside) for e, t, inside, holds in subtrees(root, False) if e.tag in htmltext.BLOCKS - {"article", "body", "html"} and not holds]

    for url, html in pages:
        _, site, articles, every = found(url, html)
        total[site, False].add(html)
        if articles:
            total[site, True].add(articles)
        for _, t, inside in every:
            seen[site, t, inside].add(articles if inside else html)
    want = []
    for url, html in pages:
        root, site, _, every = found(url, html)
        gone = {id(e) for e, t, inside in every if len(seen[site, t, inside]) >= max(10, 0.3 * len(total[site, inside]))}
        want.append(htmltext.main_text(root, gone))
    got = texts(spark, pages, min_share=0.3)
    assert got == want
    assert sum(a != b for a, b in zip(got, texts(spark, pages, min_pages=10_000), strict=True)) > 20  # the counts decide


def test_attributes_by_exact_name_and_whole_class():
    text = lambda source: htmltext.main_text(htmltext.parse(source))
    assert text('<body style="overflow-x:hidden"><article title="hidden gems"><p style="overflow:hidden">a</p><p data-id="ad">b</p><a href="/hidden/x?id=ad">c</a></article>') == "a\nb\nc"
    assert text('<article><div class="article-header"><h1 class="header">a</h1></div><h2 id="related-work">b</h2><p id="side-effects">c</p><div class="box ad">d</div><div id=comments>e</div><p class=\'ad\'>f</p></article>') == "a\nb\nc"
    assert text("<h2 id=related-work>a</h2><p id=side-effects>b</p><div class='ad-box'>c</div><p hidden>d</p><p aria-hidden='true'>e</p><p aria-hidden=false>f</p><p HIDDEN=''>g</p><div data-x=\"y\"class=ad>h</div>") == "a\nb\nf"
    assert text("<div class='layout has-sidebar'><article>a</article></div><div class=sidebar><article>b</article></div>") == "a"


def test_deep_and_broken_html(spark):
    n = 100_000
    deep = ["<div>" * n + "end", "<p>a</p>" + "<span>" * n + "end" + "</b>" * n, "<b><article>" + "<font>" * n + "end" + "</b>" * n, "<ul>" + "<li><i>x" * n, "<main>" * n + "end"]
    pages = [(i, "http://a.example/", h) for i, h in enumerate([*deep, "<p>Own text</p>"])]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {0: "end", 1: "a\nend", 2: "end", 3: "\n".join("x" * n), 4: "end", 5: "Own text"}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 100_000)).withColumn("extra", F.lit(1))
    for name, stage in cp.STAGES[:-1]:
        before, schema = docs.collect(), docs.schema
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.select(*cp.COLUMNS).schema)
        assert tuple(docs.columns) == cp.COLUMNS and {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before}
        if name.startswith("quality"):
            model = quality.train(spark.createDataFrame(before, schema), spark.read.parquet(f"{sf}/labels.parquet"))
            want = Counter(r.doc_id for r in before if plain_score(model, r.text or "") >= 0.3)
            assert sum((want - Counter(r.doc_id for r in docs.collect())).values()) <= 1 and sum((Counter(r.doc_id for r in docs.collect()) - want).values()) <= 1
        if name.startswith("language"):
            found = langid.identify(spark.createDataFrame(before, schema), langid.train(spark.createDataFrame(before, schema))).where("not rejected").collect()
            assert Counter((r.doc_id, r.lang) for r in docs.collect()) == Counter((r.doc_id, r.lang_pred) for r in found)
        if name.startswith("n-gram"):
            sets = {r.doc_id: shingles(r.text) for r in before}
            roots = components(sets)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({i for i in sets if roots[i] == i})
        if name.startswith("mixing"):
            assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 3
        assert docs.count()
    pieces = cp.pack_windows(spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    room = defaultdict(list)
    for p in pieces:
        room[p.sequence_id].append((p.offset, p.length))
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_formulas_and_parts_of_names_stay():
    assert htmltext.main_text(htmltext.parse("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>")) == "Let x=1 be."
    assert htmltext.main_text(htmltext.parse('<div class="side-effects">Drug side effects text.</div><div id="widget-guide">Guide.</div>')) == "Drug side effects text.\nGuide."
    assert htmltext.main_text(htmltext.parse('<div class="side">a</div><div class="site-sidebar">b</div><div class="ad-slot">c</div><p>d</p>')) == "d"


def test_what_goes_parts_its_neighbours():
    assert htmltext.main_text(htmltext.parse("<div>one<nav>menu</nav>two<script>x</script> three</div>")) == "one\ntwo three"
    lines, spans = htmltext.printed(htmltext.parse("<div>a<p>b</p>c</div><p></p>d"))
    assert lines == ["a", "b", "c", "d"] and sorted(spans.values()) == [(0, 3), (0, 4), (1, 2), (3, 3)]


def test_words_keep_64_bits_and_ngrams_their_own():
    shape = katz.Shape(2, (1, 1), 128, 40)
    assert shape.cut(1, np.array([0, 1 << 57, (1 << 64) - 1], np.uint64))[:3] == [0, 1, 2]
    assert shape.cut(2, np.array([0, 1 << 33, (1 << 40) - 1], np.uint64))[:3] == [0, 1, 2]


def test_stages_of_the_pipeline_give_python_small_batches(spark):
    import corpus_pipeline as cp

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(6).selectExpr("id doc_id", "repeat(concat('some words ', id, ' '), 200000) text", "'en' lang", "'web' source", "0L n_chars").coalesce(1)
        sizes = cp._with_key(docs).mapInArrow(lambda batches: (b.select([0]).slice(0, 1) for b in batches), "doc_id long")
        assert sizes.count() > 1
    finally:
        spark.conf.set(key, before)
