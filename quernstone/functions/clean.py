"""Cleaning and redaction of texts and of JSON documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal

#: Parts of a key that mark a value as sensitive.
SENSITIVE = ("password", "secret", "key", "token", "auth", "credential", "private", "pass", "pwd", "api_key", "access_key", "secret_key")
#: White space as str.isspace has it.
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip_tags(c: Column) -> Column:
    """Each tag leaves two spaces."""
    return F.regexp_replace(c, r"<[^>]+>", "  ")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def printable(c: Column) -> Column:
    """Signs that can't be printed, but for line breaks and tabs, to spaces."""
    return F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ \n\t]]", " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def clean_text(c: Column, remove_html: bool = False, normalize_whitespace: bool = False, compatibility: bool = True) -> Column:
    """Tags, then compatibility forms (compatibility=False leaves them out), then signs that can't be printed, then white space."""
    c = strip_tags(c) if remove_html else c
    if compatibility:
        c = normal.nfkc(c)
    c = printable(c)
    return collapse(c) if normalize_whitespace else c


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def redact(c: Column) -> Column:
    """Stars but for 0, 1, 2 or 3 signs at either end, by length up to 4, 8, 16 or more."""
    n = F.length(c)

    def ends(k: int) -> Column:
        return F.concat(F.substring(c, 1, k), F.repeat(F.lit("*"), n - 2 * k), F.right(c, F.lit(k)))

    return F.when(n <= 4, F.repeat(F.lit("*"), n)).when(n <= 8, ends(1)).when(n <= 16, ends(2)).otherwise(ends(3))


def is_sensitive(key: Column, more: tuple[str, ...] = ()) -> Column:
    return F.lower(key).rlike("|".join(f"\\Q{x}\\E" for x in (*SENSITIVE, *more)))


def redact_map(c: Column) -> Column:
    """A flat map with the values of sensitive keys redacted."""
    return F.transform_values(c, lambda k, v: F.when(is_sensitive(k), redact(v)).otherwise(v))


def _stars(value) -> str:
    s = str(value)
    k = 0 if len(s) <= 4 else 1 if len(s) <= 8 else 2 if len(s) <= 16 else 3
    return s[:k] + "*" * (len(s) - 2 * k) + s[len(s) - k :]


def _redacted(x):
    if isinstance(x, dict):
        return {k: _stars(v) if any(p in k.lower() for p in SENSITIVE) and not isinstance(v, (dict, list)) else _redacted(v) for k, v in x.items()}
    return [_redacted(v) for v in x] if isinstance(x, list) else x


def _redacted_texts(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else json.dumps(_redacted(json.loads(x)), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)


def redact_json(c: Column) -> Column:
    """A JSON document with the values of sensitive keys redacted, at any depth; what isn't JSON gives null."""
    return F.pandas_udf(_redacted_texts, "string")(c)


def is_blank_json(c: Column) -> Column:
    """Null, an empty text, list or object, or a list or object of nothing else."""
    bare = F.regexp_replace(c, r'\s+|"(?:[^"\\]|\\.)+"\s*:', "")
    left = F.regexp_replace(bare, r'null|""|[\[\]{},]', "")
    return c.isNull() | (left == "")


def truncated(c: Column, most: int = 250) -> Column:
    """The first `most` signs of a longer text; a shorter one gives null, as it isn't shown."""
    return F.when(F.length(c) > most, F.substring(c, 1, most))
