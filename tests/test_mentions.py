import random
import re

import pytest

from quernstone.operators import mentions


def plain(files, names):
    out = set()
    for path, text in files:
        for i, line in enumerate((text or "").split("\n"), 1):
            for n in names:
                if n and re.search(rf"\b({re.escape(n)}|{re.escape(n.replace('-', '_'))})\b", line, re.IGNORECASE):
                    out.add((path, i, n))
    return out


def found(spark, files, names, **options):
    df = spark.createDataFrame(files, "path string, text string")
    got = mentions.mentions(df, spark.createDataFrame([(n,) for n in names], "package string"), **options).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_names_next_to_other_signs(spark):
    """Seven lines of which six name the package, one of them twice and one with a mark of other checks."""
    lines = "import numpy\nnumpy-stubs\nx-foo-bar and foo_bar\nruamel.yaml\nnumpyro\nimport numpy # noqa\nNUMPY numpy"
    files, names = [("a", lines)], ["numpy", "foo-bar", "ruamel"]
    assert found(spark, files, names) == plain(files, names) == {("a", 1, "numpy"), ("a", 2, "numpy"), ("a", 3, "foo-bar"), ("a", 4, "ruamel"), ("a", 6, "numpy"), ("a", 7, "numpy")}


@pytest.mark.parametrize("passes", [1, 4])
def test_random_lines_and_names(spark, passes):
    rng = random.Random(passes)
    word = lambda: "".join(rng.choice("aAbB-_.1é ß ") for _ in range(rng.randrange(1, 5)))
    files = [(f"f{i}", "\n".join(" ".join(word() for _ in range(rng.randrange(6))) for _ in range(rng.randrange(5)))) for i in range(60)]
    files += [("none", None), ("empty", ""), ("long", "a-b " * 400_000 + "\nab"), ("twice", "a\na"), ("twice2", "a\na")]
    names = sorted({word() for _ in range(150)} | {"a", "ab", "abab", "a-b", "A_B"})
    assert found(spark, files, names, names_per_pass=-(-len(names) // passes)) == plain(files, names)


def test_no_names_and_no_files(spark):
    assert found(spark, [("a", "b")], ["", None, "b\nc"]) == set()
    assert found(spark, [], ["a"]) == set()


def test_a_hundred_thousand_names(spark):
    names = [f"name{i}-x" for i in range(100_000)]
    assert found(spark, [("a", "name7-x name7_x name77777_X xname8-x name9-xy"), ("b", "name100000-x")], names) == {("a", 1, "name7-x"), ("a", 1, "name77777-x")}


@pytest.mark.parametrize("most", [5, 1000])
def test_counts_of_many_names_read_the_texts_once(spark, monkeypatch, most):
    """Lines of a name are counted whether or not the names fill an automaton; more names are no more passes."""
    calls, searched = [], mentions._searched
    monkeypatch.setattr(mentions, "_searched", lambda *a: calls.append(1) or searched(*a))
    files = [("a", "The the-end THE\n.the. x-y x_y\nx-y\n-the"), ("b", None), ("c", "\n\nthe END"), ("c2", "é É_é-1"), ("d", "-the")]
    names = ["the", "The", "THE", "the-end", "x-y", "X-y", "x_y", "-the", ".", "-", "the.", "é", "é_É-1", "none", "", "a\nb"]
    df, known = spark.createDataFrame(files, "path string, text string"), spark.createDataFrame([(n,) for n in names], "package string")
    want = {}
    for _, _, n in plain(files, [n for n in names if "\n" not in n]):
        want[n] = want.get(n, 0) + 1
    assert {r.package: r.n_lines for r in mentions.line_counts(df, known, most).collect()} == want
    assert len(calls) == (most > len(names))
    assert found(spark, files, names, names_per_pass=most) == plain(files, [n for n in names if "\n" not in n])
    assert len(calls) == 2 * (most > len(names))
