import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import mixing, packing, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(0, None, "a"), (1, "", "a"), (2, "one two three", None), (3, "é ü  ß\n\nx\nx\nx y\n", "b"), (4, "b c " * 5000, "b"), (4, "b c " * 5000, "b"), (None, "w " * 30, "é"), (7, "  \t\n ", ""), (8, "l1 a b c d e f g h\n" * 4 + "tail # $ | <b>", "a"), (9, "don't 12 3.5   x　 y  z 'll", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 7, "extra") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, kept string")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = defaultdict(list)
    for i in range(len(w) - 7):
        runs[tuple(w[i : i + 8])].append(i)
    again = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def measures_match(out, texts):
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == Counter((i, *measured(t)) for i, t in texts)


def test_rules_against_brute_force(spark, docs, sf):
    out = rules.cascade(docs).collect()
    measures_match(out, [(r[0], r[1]) for r in ROWS])
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = rules.op7_quality_rules(spark, sf).collect()
    measures_match(rows, [(r.doc_id, r.text) for r in real.collect()])
    assert not any(r.kept and r.base_failed for r in rows)


def test_rule_order_does_not_change_the_verdict(spark, docs):
    names = [r.name for r in rules.RULES]
    one = {(r.doc_id, r.kept) for r in rules.cascade(docs, order=names, measures=()).collect()}
    assert one == {(r.doc_id, r.kept) for r in rules.cascade(docs, order=names[::-1], measures=()).collect()}
    assert sorted(rules.cascade_order(docs)) == sorted(names)
    assert rules.cascade(docs.limit(0)).count() == 0


def test_order_goes_by_what_is_left_and_what_is_known():
    """A rule whose rejections an earlier one has made is worth nothing; a measure at hand costs nothing."""
    none = lambda m: None
    abc = (rules.Rule("a", ("x",), none), rules.Rule("b", ("y",), none), rules.Rule("c", ("x", "z"), none))
    profile = rules.Profile({"x": 1.0, "y": 5.0, "z": 0.5}, {"a": 0.1, "b": 0.1, "c": 0.1}, {0b000: 50, 0b001: 10, 0b011: 30, 0b010: 2, 0b100: 20})
    assert rules.best_order(profile, abc) == ["a", "c", "b"]
    assert rules.best_order(profile, abc, ("y",)) == ["b", "c", "a"]
    assert rules.best_order(profile, abc, ("x", "y", "z")) == ["a", "c", "b"]


def test_profile_counts_every_sampled_document(spark, docs):
    profile = rules.estimate(docs, sample=10**6)
    assert sum(profile.rejected.values()) == docs.count()
    assert set(profile.tests) == {r.name for r in rules.RULES} and all(x >= 0 for x in profile.measures.values())
    for bit, name in enumerate(r.name for r in rules.RULES):
        alone = rules.cascade(docs, order=[name], measures=()).where("not kept").count()
        assert alone == sum(n for mask, n in profile.rejected.items() if mask >> bit & 1)


@pytest.mark.parametrize("measures", [(), ("n_words", "n_repeat_words")])
def test_failed_rule_is_the_first_that_rejects(spark, sf, measures):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900_000 + i, t) for i, t in enumerate([None, "", "A # B", "X X\n" * 40, "# $ % & " * 30, "a " * 60 + "\nsame\nsame"])], "doc_id long, text string"))
    rows = docs.collect()
    every = rules.Measures(next(rules.tv.chunks(pa.array([r.text for r in rows]), 1 << 40)))
    assert len(every.texts) == len(rows)
    hits = {r.name: r.rejects(every) for r in rules.RULES}
    assert sum(sum(h[i] for h in hits.values()) > 1 for i in range(len(rows))) > 4
    names = list(hits)
    for order in (names, names[::-1]):
        got = {r.doc_id: r for r in rules.cascade(docs, order=order, measures=measures).collect()}
        for i, r in enumerate(rows):
            first = next((n for n in order if hits[n][i]), None)
            assert (got[r.doc_id].failed_rule, got[r.doc_id].kept) == (first, first is None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=120), min_size=1, max_size=6))
def test_measures_on_any_text(texts):
    import pyarrow as pa

    for chunk in rules.tv.chunks(pa.array(texts), 64):
        m = rules.Measures(chunk)
        got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        assert got == [measured(t) for t in texts[chunk.first : chunk.first + len(chunk)]]


def test_mix_meets_targets(spark, sf):
    rows = mixing.op9_mixing(spark, sf).collect()
    texts = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    taken, target, size, largest = Counter(), {}, {}, Counter()
    for r in rows:
        source, n = texts[r.doc_id]
        assert r.size == n and 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
        target[source], size[source] = r.target, r.source_size
        largest[source] = max(largest[source], n)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    assert all(target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_mixing(spark, sf).collect()))


def test_mix_edges_and_overlap(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    both = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)], "doc_id long, text string, source array<string>")
    out = mixing.mix(both, weights=(1, 1)).collect()
    assert sum(r.taken for r in out) == 1000


def test_flow_is_of_least_cost():
    given = mixing.min_cost_flow([(("a",), 10), (("a", "b"), 10)], {"a": 10, "b": 10}, 3)
    assert given == [{"a": 10}, {"a": 0, "b": 10}]
    assert mixing.shares({"a": 10, "b": 100}, {"a": 5, "b": 1}, 110, 3) == {"a": 30.0, "b": 80.0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([("a",), ("b",), ("a", "b")]), st.integers(0, 2)), min_size=1, max_size=3), st.integers(0, 7), st.integers(0, 7))
def test_flow_against_all_flows(patterns, quota_a, quota_b):
    """As much of the quotas as can be served, at the least cost of repetition: of all whole flows, none is better."""
    quota = {s: q for s, q in (("a", quota_a), ("b", quota_b)) if any(s in m for m, _ in patterns)}

    def cost(size, used):  # use k of a word costs k - 1
        return sum(max(0, min(used - k * size, size)) * k for k in range(3)) if size else 0

    options = [[dict(zip(m, x, strict=True)) for x in itertools.product(range(3 * n + 1), repeat=len(m)) if sum(x) <= 3 * n] for m, n in patterns]
    best = None
    for flow in itertools.product(*options):
        served = {s: sum(g.get(s, 0) for g in flow) for s in quota}
        if all(served[s] <= quota[s] for s in quota):
            key = (-sum(served.values()), sum(cost(n, sum(g.values())) for g, (_, n) in zip(flow, patterns, strict=True)))
            best = key if best is None or key < best else best
    flow = mixing.min_cost_flow(patterns, quota, 3)
    assert all(sum(g.values()) <= 3 * n for g, (_, n) in zip(flow, patterns, strict=True))
    served = {s: sum(g.get(s, 0) for g in flow) for s in quota}
    assert all(served[s] <= quota[s] for s in quota)
    assert (-sum(served.values()), sum(cost(n, sum(g.values())) for g, (_, n) in zip(flow, patterns, strict=True))) == best


def test_plans_beyond_the_broadcast(spark, docs, monkeypatch):
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(piece) == r.length
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
    copies = Counter(i for i, _ in texts)
    for i, pieces in by_doc.items():
        assert Counter(k for p in pieces for k in range(p.start, p.start + p.length)) == Counter({k: copies[i] for k in range(len(ids[i]))})
    assert set(by_doc) == set(ids)
    for s, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


def test_pack_against_the_library(spark, docs, sf):
    check_pieces(packing.pack(docs, packing.default_tokenizer()).collect(), [(r[0], r[1]) for r in ROWS])
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sequences = check_pieces(packing.op10_packing(spark, sf).collect(), texts)
    sizes = Counter()
    for pieces in sequences.values():
        for p in pieces:
            sizes[p.source] += p.length
    for pieces in sequences.values():  # each full window has every source in proportion
        share = Counter()
        for p in pieces:
            share[p.source] += p.length
        if sum(share.values()) == 1024:
            assert all(abs(share[s] - 1024 * n / sum(sizes.values())) < 3 for s, n in sizes.items())
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_pack_with_weights_carries_deficits(spark):
    docs = spark.createDataFrame([(i, "a b c d e f", "x" if i % 3 else "y") for i in range(300)], "doc_id long, text string, source string").repartition(5)
    rows = packing.pack(docs, packing.default_tokenizer(), length=64, weights={"x": 3.0, "y": 1.0}).collect()
    for s in range(10):
        assert abs(sum(r.length for r in rows if r.sequence_id <= s and r.source == "x") - 48 * (s + 1)) <= 1


SPACES = st.text(alphabet=st.sampled_from("ab é1'.<|  　\u0085\n\t  ü中"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(SPACES, min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quernstone.llm import bpe

    library = Tokenizer.from_file(packing.default_tokenizer())
    for chunk, ids, offsets in bpe.encode_column(pa.array(texts), packing.default_tokenizer()):
        for i in range(len(chunk)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(texts[chunk.first + i], add_special_tokens=False).ids


def test_schedule_is_the_order_of_times():
    rng = np.random.default_rng(1)
    for turn in range(80):
        n = int(rng.integers(1, 12))
        sizes = rng.integers(1, 30, n)
        weights = sizes.astype(float) if turn % 2 else rng.choice([1.0, 1.0, 2.0, 5.0], n)
        tokens = sorted(((k + 0.5) / w, q) for q, (size, w) in enumerate(zip(sizes.tolist(), weights.tolist(), strict=True)) for k in range(size))
        want = np.zeros((len(tokens) + 1, n), int)
        for i, (_, q) in enumerate(tokens):
            want[i + 1] = want[i]
            want[i + 1, q] += 1
        assert (packing.Schedule(sizes, weights).counts(np.arange(len(tokens) + 1)) == want).all()


def test_many_sources_take_no_longer():
    """Thousands of queues in packing, and a hundred thousand sources in mixing."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100_000, 4000)
    began = time.time()
    counts = packing.Schedule(sizes, sizes).counts(rng.integers(0, sizes.sum(), 200))
    patterns = [((f"s{i}",), int(n)) for i, n in enumerate(rng.integers(1, 10_000, 100_000))]
    of = {p[0][0]: p[1] for p in patterns}
    quota = {s: round(t) for s, t in mixing.shares(of, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(of)}, sum(of.values()), 3).items()}
    given = mixing.min_cost_flow(patterns, quota, 3)
    assert time.time() - began < 30
    assert counts.shape == (200, 4000) and [g[p[0][0]] for g, p in zip(given, patterns, strict=True)] == [quota[p[0][0]] for p in patterns]


def test_sources_alone_and_shared():
    """Sources without a choice beside ones that share documents: all quotas that can be met are."""
    patterns = [(("a",), 10), (("b",), 10), (("b", "c"), 10), (("d",), 0), ((), 5)]
    given = mixing.min_cost_flow(patterns, {"a": 25, "b": 35, "c": 20, "d": 3}, 3)
    assert given[0] == {"a": 25} and given[1]["b"] + given[2]["b"] == 35 and given[2]["c"] == 20 and given[3] == {"d": 0}
