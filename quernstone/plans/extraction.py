"""Queries of lists out of documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, extract
from ..operators import code
from ..sources import files
from .common import table
from .types import FILE_NAMES_SQL, _file_names

#: What stands before and behind a document's lines, by turns, to make Markdown of it.
BEFORE = ("# ", "", "> ", "- ", "1. ", "    ", "## ", "[", "![", "<http://auto.link/", "", "---", "* ", "![k][", "[r", "\t")
BEHIND = ("", "", "", "", "", "", "", "](http://x.y)", "](i.png)", ">", "\n\n  more  \n", "", "", "]", "]: http://z", "`c` *b* (y)!")
_SIDE = lambda texts: "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for x in texts) + "]"
_M = f"(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_SIDE(BEFORE)}[(i - 1) % {len(BEFORE)} + 1] || CASE WHEN (i - 1) % {len(BEFORE)} = 11 THEN '' ELSE x END || {_SIDE(BEHIND)}[(i - 1) % {len(BEFORE)} + 1]), chr(10)) AS s FROM documents)"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, s: documents as Markdown, with marks around their lines; every twelfth is a rule."""
    side = lambda texts, i: F.element_at(F.array(*map(F.lit, texts)), i % len(BEFORE) + 1)
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(side(BEFORE, i), F.when(i % len(BEFORE) == 11, "").otherwise(x), side(BEHIND, i)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("s"))


CHUNK = "list_filter(list_transform(range(0, length(text), 1800), lambda i: substr(text, i + 1, 2000)), lambda x: regexp_matches(x, '\\S'))"


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.explode(extract.chunks(F.col("text"))).alias("chunk"))
    return d.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))


def ut01_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = extract.chunk_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def ut02_chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function on each chunk, which fails where a chunk has an address."""
    return extract.map_chunks(extract.chunk_rows(table(spark, sf_dir, "documents"), "doc_id", "text"), _shouted)


def _shouted(chunk: str) -> str:
    if "@" in chunk:
        raise ValueError("an address")
    return chunk.upper()


def ut03_document_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files, chunks, a function on each, and the results written and read again; the files are documents as bytes."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    at = files.scratch_dir(spark, "results")
    files.document_pipeline(d, lambda f: f.select("path", code.decoded(F.col("content")).alias("text")), _shouted, at)
    back = spark.read.parquet(at)
    return back.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n_chunks"), F.count("error").alias("n_failed"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"))


def ut04_lines_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(extract.lines(F.col("text"))).alias("n_lines"), F.size(extract.words(F.col("text"))).alias("n_words"), F.try_element_at(extract.words(F.col("text")), F.lit(1)).alias("first_word"))


def _md(**columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _markdown(spark, sf_dir).select("doc_id", *(f(F.col("s")).alias(n) for n, f in columns.items()))

    return run


def _pair(f, part: str):
    joined = lambda c: F.array_join(F.transform(f(c)[part], lambda x: F.concat(x["text"], F.lit("|"), x["target"])), ";")
    return joined


QUERIES = {f.__name__: f for f in (chunk_documents, ut01_chunks, ut02_chunk_map, ut03_document_pipeline, ut04_lines_words)} | {
    "ut05_md_sections": _md(out=extract.md_sections),
    "ut06_md_headers": _md(one=extract.md_headers, two=lambda c: extract.md_headers(c, 2)),
    "ut07_md_paragraphs": _md(out=extract.md_paragraphs),
    "ut08_md_blocks": _md(quotes=extract.md_blockquotes, unordered=lambda c: extract.md_lists(c)["unordered"], ordered=lambda c: extract.md_lists(c)["ordered"], code=extract.md_code_lines, rules=extract.md_rules),
    "ut09_md_links": _md(inline=_pair(extract.md_links, "inline"), reference=_pair(extract.md_links, "reference"), images=_pair(extract.md_images, "inline"), image_references=_pair(extract.md_images, "reference"), auto=extract.md_autolinks),
    "ut10_md_escape": _md(out=extract.md_escape),
}


def ut11_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(extract.html_links(F.col("html"))).alias("link"))
    return p.groupBy("page_id", "link").agg(F.count("*").alias("n"))


def ut12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean.strip_html(F.col("html"))).alias("digest"), F.length(clean.strip_html(F.col("html"))).alias("n_chars"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(spark, sf_dir)
    name = F.when(F.col("p_partkey") % 3 == 0, "page.tsx").otherwise("part.tsx")
    part = F.when(F.col("p_partkey") % 6 == 0, F.lit("[id]/")).otherwise(F.lit(""))
    return f.select("p_partkey", F.concat(F.lit("app/"), F.col("p_partkey").cast("string"), F.lit("/"), part, name).alias("path"))


def ut13_page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_routes(_routes(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (ut11_html_links, ut12_html_text, ut13_page_routes)}


def _all(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN s IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(s, '{pattern}', {group}) END"


def _zip(pattern: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_zip(regexp_extract_all(s, '{pattern}', 1), regexp_extract_all(s, '{pattern}', 2)), lambda x: x[1] || '|' || x[2]), ';'), '')"


_ORDERED, _CODE, _RULE = r"(?m)^[0-9]+\. (.+)$", r"(?m)^(?:    |\t)(.+)$", r"(?m)^(---|\*\*\*|___)$"
_INLINE, _REFERENCE, _IMAGE = r"\[([^\]]+)\]\(([^)]+)\)", r"\[([^\]]+)\]: ([^\s]+)", r"!\[([^\]]*)\]\[([^\]]+)\]"
ORACLE_SQL = {
    "chunk_documents": f"SELECT lang, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS n_chars FROM (SELECT lang, unnest({CHUNK}) AS chunk FROM documents) GROUP BY lang",
    "ut01_chunks": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, length(c[i]) AS n_chars, md5(c[i]) AS digest FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {CHUNK} AS c FROM documents))",
    "ut02_chunk_map": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, CASE WHEN NOT contains(c[i], '@') THEN upper(replace(c[i], 'ß', 'SS')) END AS content, CASE WHEN contains(c[i], '@') THEN 'an address' END AS error FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {CHUNK} AS c FROM documents))",
    "ut03_document_pipeline": f"SELECT doc_id, count(*) AS n_chunks, count(CASE WHEN contains(x, '@') THEN 1 END) AS n_failed, CAST(coalesce(sum(CASE WHEN NOT contains(x, '@') THEN length(replace(x, 'ß', 'SS')) END), 0) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest({CHUNK}) AS x FROM documents) GROUP BY doc_id",
    "ut04_lines_words": "SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, len(coalesce(regexp_extract_all(text, '[^\\s\\x0b]+'), [])) AS n_words, regexp_extract_all(text, '[^\\s\\x0b]+')[1] AS first_word FROM documents",
    "ut05_md_sections": f"SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(s, '(?m)^# ') END AS out FROM {_M}",
    "ut06_md_headers": f"SELECT doc_id, {_all('(?m)^# (.+)$')} AS one, {_all('(?m)^## (.+)$')} AS two FROM {_M}",
    "ut07_md_paragraphs": f"SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(s, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10))) END AS out FROM {_M}",
    "ut08_md_blocks": f"SELECT doc_id, {_all('(?m)^> (.+)')} AS quotes, {_all('(?m)^[*+-] (.+)$')} AS unordered, {_all(_ORDERED)} AS ordered, {_all(_CODE)} AS code, {_all(_RULE)} AS rules FROM {_M}",
    "ut09_md_links": f"SELECT doc_id, {_zip(_INLINE)} AS inline, {_zip(_REFERENCE)} AS reference, {_zip('!' + _INLINE.replace('+)', '*)', 1))} AS images, {_zip(_IMAGE)} AS image_references, {_all('<(https?://[^>]+)>')} AS auto FROM {_M}",
    "ut10_md_escape": "SELECT doc_id, regexp_replace(s, '([\\\\`*_{}\\[\\]()#+\\-.!])', '\\\\\\1', 'g') AS out FROM " + _M,
    "ut11_html_links": "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=[''\"]?([^''\" >]+)', 1)) AS link FROM pages) GROUP BY page_id, link",
    "ut12_html_text": "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_chars FROM pages",
    "ut13_page_routes": "SELECT '/app/' || p_partkey AS route FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 6 <> 0",
}
