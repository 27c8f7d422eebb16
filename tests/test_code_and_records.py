"""What SQL can't tell: syntax trees, class text, Python steps, file sources and streams."""

from __future__ import annotations

import io
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from quernstone.functions import case, clean, extract, inflect, normal, paths, urls
from quernstone.functions import validators as V
from quernstone.operators import access, callers, code, mentions, records, versions
from quernstone.operators.records import Field
from quernstone.plans import corpus
from quernstone.sources import files
from quernstone.streaming import versions as stream


PY = '''"""A module."""
import os, json.decoder
from typing import Optional
from . import near

LIMIT = 5
Name = Optional[str]


class Shape(BaseModel):
    side: int = 2
    label: str = Field(default="x")

    async def area(self, scale: float = 1.0, *rest, unit="m", **more) -> float:  # size
        return self._grow(scale)


def total(items, /, key=None):
    return sum(area(i) for i in items)  # uses numpy


def area(x):
    return os.path.join("numpy", x)
'''
TS = """// first
import React, { useState, useMemo } from 'react';
import { Box } from '@/ui/Box';
import { x } from './near';
import { y } from './near';
export const Card = (props: Props): Item => {
  return null; /* note */
};
export interface Props { a: string }
export { Box, helper };
export default function Main(a: number) { return a; }
class Inner { size(): number { return 1; } }
"""
GO = "package main\n// add\nfunc Add(a int, b int) int {\n\treturn a + b\n}\ntype Pair struct {\n}\n"
FILES = [("app/main.py", PY), ("app/broken.py", "def broken(:\n"), ("web/card.tsx", TS), ("pkg/add.go", GO), ("pkg/empty.rb", ""), ("web/page.tsx", "export default Page\n# x\n\n\n\n\nend"), ("docs/read.md", "# not code")]


def own_files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, f, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_snake_forms_differ(spark):
    assert one(spark, case.snake, "ABC", "XML http-Req", "_x", None) == ["a_b_c", "x_m_l_http_req", "_x", None]
    assert one(spark, case.snake_two_pass, "HTTPServer") == ["http_server"]
    assert one(spark, case.acronym_snake, "AISettings", "getURL2Go") == ["ai_settings", "get_url2_go"]


def test_titles_follow_letters(spark):
    assert one(spark, case.pascal, "a1b c", "") == ["A1BC", ""]
    assert one(spark, case.camel, "hello-World", "ab") == ["helloWorld", "ab"]
    assert one(spark, case.pretty, "my_name1st", "getHTTP") == ["My Name1St", "Get H T T P"]


def test_inflection(spark):
    assert one(spark, inflect.plural, "Person", "box", "city", "data", "day", "", None) == ["People", "boxes", "cities", "data", "days", "", None]
    assert one(spark, inflect.singular, "People", "boxes", "cities", "series", "") == ["Person", "box", "city", "series", ""]


def test_clean_folds_compatibility_forms(spark):
    assert one(spark, lambda c: clean.clean_text(c, True, True), "ﬁn<b>e</b>​x", " a  b ", None) == ["fin e x", "a b", None]


def test_compatibility_forms_of_all_signs(spark):
    """Every sign alone, behind a letter and behind another sign that takes marks; texts that stay as they are too."""
    signs = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(signs[i : i + 64]) for i in range(0, len(signs), 64)] + [f"e{c}\u1100{c}\u0327x" for c in signs if unicodedata.combining(c) or not unicodedata.is_normalized("NFKC", c)] + ["\uac00\u11a8", "\u1100\u1161\u11a8", "a\u0301", "\u09c7\u09be", "plain", "\u00e9t\u00e9"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.out for r in df.select("i", normal.nfkc(F.col("s")).alias("out")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != unicodedata.normalize("NFKC", t)] == []
    assert "Python" not in df.select(clean.clean_text(F.col("s")))._jdf.queryExecution().executedPlan().toString()


def test_redaction_keeps_containers(spark):
    got = one(spark, clean.redact_json, '{"token": {"a": 1, "pwd": "secretvalue"}, "n": [{"key": "abcde"}]}', "no json", None)
    assert got == ['{"token": {"a": 1, "pwd": "se*******ue"}, "n": [{"key": "a***e"}]}', None, None]


def test_addresses(spark):
    assert one(spark, lambda c: V.check_ip(c)["ok"], "::1", "fe80::1", "1::2::3", "1.2.3.4", None) == [True, True, False, True, False]
    assert one(spark, lambda c: V.check_url(c)["code"], "http://[::1]/", "http://[:]/", "http://münchen.de/x") == [None, "invalid_ipv6_in_url", None]
    assert one(spark, V.is_email, "ü@münchen.de", "a@b") == [True, False]


def test_empty_texts_give_empty_lists(spark):
    for f in (extract.chunks, extract.lines, extract.words, extract.md_sections, extract.md_headers, extract.html_links):
        assert one(spark, f, "", None) == [[], []]


def test_chunk_tail_may_only_repeat(spark):
    assert one(spark, lambda c: extract.chunks(c, 4, 2), "abcdef", "      ") == [["abcd", "cdef", "ef"], []]


def test_paths(spark):
    assert one(spark, paths.normal, "a/./b/../C", "/../x", "..\\y", "", "a/..") == ["a/c", "/x", "../y", ".", "."]
    assert one(spark, paths.ancestors, "a/b/c.txt", "x", "") == [["a", "a/b"], [], []]


def test_storage_urls_reject_others(spark):
    assert one(spark, urls.is_storage_url, "s3://a/b", "https://x.y/z", None) == [True, False, False]


def test_python_signatures(spark):
    got = [r.signature for r in code.python_signatures(own_files(spark)).orderBy("path", "pos").collect() if r.signature]
    assert got == [
        "LIMIT = 5", "Name = Optional[str]", "class Shape(BaseModel):", "    # fields: side: int = 2, label: str = 'x'",
        "    async def area(self, scale: float = 1.0, *rest, unit = 'm', **more) -> float", "def total(items, /, key = None)",
    ]
    assert [r.path for r in code.python_signatures(own_files(spark)).where("error is not null").collect()] == ["app/broken.py"]


def test_signatures_of_all_kinds(spark):
    source = ("A = 1\nAb_c = 2\nAbC = [1]*3\nLONG = [%s]\n_P = 3\nX: Optional[int] = None\nQ: int = 3\nkind = Enum('a')\n" % ", ".join(["123456789"] * 20)) + (
        "class M(BaseModel, K):\n    a: int\n    b: str = ...\n    c: str = Field(..., description='z')\n    d: list = Field(default_factory=list)\n    e: int = Field(default=3)\n    _f: int = 3\n"
        "    class In:\n        async def go(self, *, k: int = 3, **kw): pass\n    def m(self, a, /, b=1, *c, d=2) -> 'x': pass\nclass E: pass\ndef m(): pass\ndef f(a=1, /, b: int=2, *, c):\n    def g(x): pass\n"
    )
    df = spark.createDataFrame([("a.py", source), ("b.py", ""), ("c.py", "def ("), ("d.py", None)], "path string, text string")
    assert [r.signature for r in code.python_signatures(df).where("path = 'a.py'").orderBy("pos").collect()] == [
        "AbC = [1] * 3", "LONG = [20 items]", "X: Optional[int] = None", "kind = Enum('a')", "class M(BaseModel, K):", "    # fields: a: int, b: str = ..., c: str, d: list = list(), e: int = 3",
        "    def m(self, a, /, b = 1, *c, d = 2) -> 'x'", "class E:", "class In:", "    async def go(self, *, k: int = 3, **kw)", "def f(a = 1, /, b: int = 2, *, c)", "def g(x)",
    ]
    assert rows(code.python_signatures(df).where("path <> 'a.py'")) == [("c.py", "SyntaxError", None, None)]
    assert rows(code.definitions(df).where("kind = 'method'").select("class", "name", "args")) == [("M", "m", ["b"]), ("In", "go", ["self"])]


def test_calls_skip_private_and_ignored(spark):
    got = rows(code.calls(own_files(spark), ignore=("sum",)).where("error is null").select("caller", "callee", "line"))
    assert got == [(None, "app.main.Field", 12), ("app.main.total", "app.main.area", 19), ("app.main.area", "...join", 23)]


def test_definitions_hide_functions_named_as_methods(spark):
    got = rows(code.definitions(own_files(spark)).where("error is null").select("kind", "name", "args"))
    assert got == [("class", "Shape", []), ("method", "area", ["self", "scale"]), ("function", "total", ["key"])]


def test_regex_signatures(spark):
    got = [r.signature for r in code.regex_signatures(own_files(spark)).where("lang = 'go'").orderBy("pos").collect()]
    assert got == ["func Add(a int, b int) int", "type Pair struct"]


def test_imports_and_mentions(spark):
    python = own_files(spark).where("path like '%.py'")
    assert rows(code.python_imports(own_files(spark)).where("error is null").select("path", "import_name", "line")) == [("app/main.py", "os", 2), ("app/main.py", "json", 2), ("app/main.py", "typing", 3)]
    got = {(r.line, r.package, r.context) for r in code.mention_context(python, mentions.mentions(python, spark.createDataFrame([("numpy",), ("json",)], "package string"))).collect()}
    assert got == {(2, "json", "code"), (19, "numpy", "comment"), (23, "numpy", "comment")}


def test_context_modes_shrink(spark):
    size = {m: sum(len(r.body) for r in code.context(own_files(spark), m).collect()) for m in ("original", "clean", "signatures", "tree")}
    assert size["tree"] < size["signatures"] < size["clean"] < size["original"]


def test_tree_lines(spark):
    assert [r.line for r in code.tree_rows(own_files(spark)).orderBy("parts").collect()][:3] == ["app/", "    broken.py", "    main.py"]


def test_callers_over_files(spark):
    """Renamed, relative and whole-module imports, a cycle, and a function that nobody calls."""
    files = [
        ("p/a.py", "def one(): pass\ndef two(): one()\ndef loop(): again()\ndef again(): loop()\n"), ("p/b.py", "from p.a import one as uno\nfrom . import a\nimport p.a as pa\ndef three(): uno()\ndef four(): a.two()\nclass C:\n    def five(self): pa.loop()\n"),
        ("q/c.py", "from p import b\nfrom ..p.b import three\ndef six(): b.four()\ndef seven(): three(); seven()\ndef eight(): one()\n"), ("bad.py", "def ("),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    symbols = code.python_symbols(df).where("error is null")
    assert {(r.path, r.local, r.target) for r in symbols.collect()} == {("p/b.py", "uno", "p.a.one"), ("p/b.py", "a", "p.a"), ("p/b.py", "pa", "p.a"), ("q/c.py", "b", "p.b"), ("q/c.py", "three", "p.b.three")}
    edges = callers.resolved(code.calls(df).where("error is null"), symbols)
    asked = spark.createDataFrame([("p.a.one",), ("p.a.loop",), ("q.c.seven",), ("q.c.eight",)], "function string")
    got = {(r.function, r.caller, r.depth) for r in callers.reaching(edges, asked).collect()}
    assert got == {
        ("p.a.one", "p.a.two", 1), ("p.a.one", "p.b.three", 1), ("p.a.one", "p.b.four", 2), ("p.a.one", "q.c.six", 3), ("p.a.one", "q.c.seven", 2), ("p.a.loop", "p.a.again", 1), ("p.a.loop", "p.a.loop", 2), ("p.a.loop", "p.b.five", 1), ("q.c.seven", "q.c.seven", 1),
    }


def test_class_text_runs(spark):
    fields = [Field("b", "int", default=2), Field("a", always=True), Field("c", "list", of="int")]
    scope: dict = {}
    exec(records.class_text(spark.createDataFrame(records.field_rows("Thing", fields), records.FIELD_ROWS)).head().text, scope)
    assert scope["Thing"]("x").to_dict() == {"a": "x", "b": 2}
    assert records.struct_of(fields).simpleString() == "struct<b:bigint,a:string,c:array<bigint>>"


def test_shape_of_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, {"aB": "1", "a_b": None}), (2, None)], "present_id int, values map<string,string>")
    got = rows(records.shape(df, "values", [Field("a_b", "int"), Field("z", always=True, default=7)], camel=True).orderBy("present_id"))
    assert got == [(1, None, "7", ["a_b", "z"]), (2, None, "7", ["z"])]


def test_upsert_revives_and_keeps(spark):
    t = spark.createDataFrame([(1, "a", "2020"), (2, "b", None)], "id int, v string, deleted_at string")
    got = rows(versions.upsert(t, spark.createDataFrame([(1, None), (3, "c")], "id int, v string"), ["id"]).orderBy("id"))
    assert got == [(1, "a", None), (2, "b", None), (3, "c", None)]


def test_modes_of_permission_disagree_on_public_files(spark):
    f = spark.createDataFrame([(1, 9, "/x", 5, "public", None)], "id int, owner_id int, path string, parent_folder_id int, visibility string, deleted_at timestamp")
    d = spark.createDataFrame([(5, 8, "/", "private", None)], "id int, owner_id int, path string, visibility string, deleted_at timestamp")
    p = spark.createDataFrame([(1, "file", 7, "user", "write", None)], "resource_id int, resource_type string, grantee_id int, grantee_type string, permission_level string, expires_at timestamp")
    m = spark.createDataFrame([], "group_id int, user_id int")
    asked = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (1, 6), (2, 7)], "id int, user_id int")
    now = F.lit("2020-01-01").cast("timestamp")
    assert {r.user_id: r.level for r in access.effective(asked, f, d, p, m, now, "max").where("id = 1").collect()} == {6: "read", 7: "write", 8: "admin", 9: "admin"}
    assert {r.user_id: r.level for r in access.effective(asked, f, d, p, m, now, "tiered").where("id = 1").collect()} == {6: "read", 7: "read", 8: "read", 9: "admin"}
    assert [r.level for r in access.effective(asked, f, d, p, m, now).where("id = 2").collect()] == [None]
    assert access.effective(asked.limit(0), f, d, p, m, now).count() == 0


def test_file_tree_and_text(spark, tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    for name in ("a/x.py", "a/node_modules/y.py", "a/z.txt", "my_test_file.py"):
        (tmp_path / name).write_text("text of " + name)
    got = files.tree(spark, f"file://{tmp_path}", exact=("node_modules",), words=("test",), include=(".py",))
    assert [r.path for r in got.collect()] == ["a/x.py"]
    assert {r.text for r in files.read_text(spark, f"{tmp_path}/a/*.txt").collect()} == {"text of a/z.txt"}
    out = f"{tmp_path}/report"
    files.write_report(spark.range(2), out, "json")
    assert spark.read.json(out).count() == 2


def test_slides(spark):
    buffer = io.BytesIO()
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f"<s {ns}><a:p><a:t>Head</a:t></a:p><a:p><a:t>Body</a:t></a:p></s>")
        z.writestr("ppt/slides/slide2.xml", f"<s {ns}/>")
    df = spark.createDataFrame([("d.pptx", bytearray(buffer.getvalue())), ("bad", bytearray(b"x")), ("none", None)], "path string, content binary")
    assert rows(files.slides(df)) == [("d.pptx", 1, "Head", "Head\nBody")]


def test_streamed_counts(spark, tmp_path):
    src = spark.range(20).selectExpr("timestamp_seconds(id * 60) ts", "'click' event_type")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    df = stream.windowed_counts(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), "5 minutes")
    df.writeStream.format("memory").queryName("s_counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in spark.table("s_counts").collect()) == [5, 5, 5, 5]


def test_chunk_map_gives_whole_chunks(spark, sf):
    from quernstone.functions import extract
    from quernstone.plans import extraction

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    failed = lambda chunk: "@" in chunk
    want = {(r.doc_id, r.chunk_index): (None, "an address") if failed(r.chunk) else (r.chunk.upper(), None) for r in extract.chunk_rows(docs, "doc_id", "text").collect()}
    got = {(r.doc_id, r.chunk_index): (r.content, r.error) for r in extraction.ut02_chunk_map(spark, sf).collect()}
    assert got == want and {e for _, e in got.values()} == {None, "an address"}
    assert max(len(c or "") for c, _ in got.values()) > 20
    assert extract.map_chunks(extract.chunk_rows(docs.limit(0), "doc_id", "text"), str.upper).count() == 0


def test_paths_under_a_root(spark):
    assert one(spark, lambda c: paths.resolved(F.lit("/srv/app/"), c), "a/b", "./a/../c", "../../etc", "../../../x", "", "//y/.", None) == ["/srv/app/a/b", "/srv/app/c", "/etc", "/../x", "/srv/app", "/srv/app/y", None]


def test_typescript_literals(spark):
    from quernstone.functions import convert

    got = one(spark, convert.typescript_literal, '{"a": {}, "b c": [1, -2.5, "q\\n\\"x"], "d": {"e": null}}', "[]", '"s"', "7", "no json", None)
    assert got == ['{\n    a: {\n        \n    },\n    "b c": [\n        1,\n        -2.5,\n        "q\n"x"\n    ],\n    d: {\n        e: null\n    }\n}', "[\n    \n]", '"s"', "7", None, None]
    assert one(spark, lambda c: convert.typescript_const(c, "X", export=False), '{"aB_c": 1}') == ["const X = {\n    aBC: 1\n};\n"]


def test_marks_of_lines_and_files(spark):
    files = [("a", "import os\nfrom x.y import z  # noqa\nfrom . import near\n  from q.r import s\nimportant = 1"), ("b", "# noqa: import-checker\nimport os"), ("c", "\n\n\n\n\n# noqa: import-checker\nimport re, sys"), ("d", None)]
    df = spark.createDataFrame(files, "path string, text string")
    assert sorted(rows(code.checked_imports(df))) == [("a", 1, "os"), ("a", 4, "q.r"), ("c", 7, "re")]
    assert sorted(rows(code.checked_imports(df, ("os", "q")))) == [("c", 7, "re")]


def test_source_files_are_dealt_to_all_cores(spark):
    files = corpus.sources(spark, "/root/testdata/sf0.1")
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
    assert sum(sizes) == spark.read.parquet("/root/testdata/sf0.1/part.parquet").count()
