"""Lists out of texts: chunks, lines, Markdown and HTML parts.  A null or empty text gives an empty list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import SPACE


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), group), _none())


def chunks(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Pieces of `size` signs that begin every size - overlap signs; blank pieces are left out, a last one that only
    repeats stays."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))
    made = F.filter(F.transform(starts, lambda i: F.substr(c, i + 1, F.lit(size))), lambda x: ~x.rlike(rf"^{SPACE}*\z"))
    return F.when(F.length(c) > 0, made).otherwise(_none())


def chunk_rows(df: DataFrame, key: str, text: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """key, chunk_index, chunk."""
    return df.select(F.col(key), F.posexplode(chunks(F.col(text), size, overlap)).alias("chunk_index", "chunk"))


def map_chunks(chunked: DataFrame, function: Callable[[str], str]) -> DataFrame:
    """The columns of chunk_rows with content, what a caller's function makes of the chunk, in its place, and error: the
    text of the exception where it fails, which leaves the other chunks alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content, error = [], []
            for chunk in b["chunk"]:
                try:
                    content.append(function(chunk))
                    error.append(None)
                except Exception as e:
                    content.append(None)
                    error.append(str(e))
            yield b.drop(columns="chunk").assign(content=content, error=error)

    kept = [f for f in chunked.schema.fields if f.name != "chunk"]
    return chunked.mapInPandas(run, T.StructType([*kept, T.StructField("content", T.StringType()), T.StructField("error", T.StringType())]))


def lines(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", _none()).otherwise(F.split(c, "\n", -1))


def words(c: Column) -> Column:
    return F.coalesce(F.filter(F.split(c, SPACE + "+", -1), lambda x: x != ""), _none())


def md_sections(c: Column) -> Column:
    """Texts between first-level headers; what stands before the first one comes first."""
    return F.when(F.coalesce(c, F.lit("")) == "", _none()).otherwise(F.split(c, "(?m)^# ", -1))


def md_headers(c: Column, level: int = 1) -> Column:
    if level < 1:
        raise ValueError("a header's level is 1 or more")
    return _found(c, rf"(?m)^{'#' * level} (.+)$")


def md_paragraphs(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", _none()).otherwise(F.transform(F.split(c, "\n\n", -1), lambda p: F.regexp_replace(p, rf"^{SPACE}+|{SPACE}+\z", "")))


def md_blockquotes(c: Column) -> Column:
    return _found(c, r"(?m)^> (.+)")


def md_lists(c: Column) -> Column:
    return F.struct(_found(c, r"(?m)^[*+-] (.+)$").alias("unordered"), _found(c, r"(?m)^\d+\. (.+)$").alias("ordered"))


def md_code_lines(c: Column) -> Column:
    """Lines after four spaces or a tab."""
    return _found(c, r"(?m)^(?:    |\t)(.+)$")


def md_rules(c: Column) -> Column:
    return _found(c, r"(?m)^(---|\*\*\*|___)$")


def _pairs(c: Column, pattern: str) -> Column:
    both = F.arrays_zip(_found(c, pattern, 1).alias("a"), _found(c, pattern, 2).alias("b"))
    return F.transform(both, lambda x: F.struct(x["a"].alias("text"), x["b"].alias("target")))


def md_links(c: Column) -> Column:
    """Inline and reference links; the links of images are among the inline ones."""
    return F.struct(_pairs(c, r"\[([^\]]+)\]\(([^)]+)\)").alias("inline"), _pairs(c, r"\[([^\]]+)\]: ([^\s]+)").alias("reference"))


def md_images(c: Column) -> Column:
    return F.struct(_pairs(c, r"!\[([^\]]*)\]\(([^)]+)\)").alias("inline"), _pairs(c, r"!\[([^\]]*)\]\[([^\]]+)\]").alias("reference"))


def md_autolinks(c: Column) -> Column:
    return _found(c, r"<(https?://[^>]+)>")


def md_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+\-.!])", r"\\$1")


def html_links(c: Column) -> Column:
    return _found(c, r"""href=['"]?([^'" >]+)""")


def page_routes(files: DataFrame, path: str = "path", skip_dynamic: bool = True) -> DataFrame:
    """route of each folder that holds page.tsx; [x] parts make a route dynamic."""
    found = files.where(F.col(path).rlike(r"(^|/)page\.tsx$")).select(F.concat(F.lit("/"), F.regexp_replace(F.col(path), r"/?page\.tsx$", "")).alias("route"))
    return found.where(~F.col("route").rlike(r"\[[^/]*\]")) if skip_dynamic else found
