"""Values of named types from texts, and texts of values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validators as V

_UUID = r"(?i)^\{?(urn:)?(uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def _uuid(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"(?i)urn:|uuid:|[{}-]", ""))
    return F.when(c.rlike(_UUID), F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def is_json(c: Column) -> Column:
    """Whether a text is one JSON document.  The parser stops behind the first one, so the text must also be good as an array's
    only item and as an object's only value."""
    good = lambda text: F.try_parse_json(text).isNotNull()
    return good(F.concat(F.lit("["), c, F.lit("]"))) & good(F.concat(F.lit('{"a":'), c, F.lit("}")))


def convert(value: Column, kind: Column) -> Column:
    """struct<v_int, v_double, v_bool, v_json, v_timestamp, v_decimal, v_binary, v_str, ok> of a text and its type's name.

    Empty texts, `null` and `NULL` are null everywhere; `{...}!` stays a text.  What can't be converted stays a text in
    v_str, with ok false; else v_str holds the value's canonical text.
    """
    empty = value.isNull() | value.isin("", "null", "NULL")
    raw = ~empty & value.rlike(r"^\{.*\}!$")
    live = ~empty & ~raw

    def of(name, v: Column) -> Column:
        return F.when(live & kind.isin(*(name if isinstance(name, tuple) else (name,))), v)

    v_int = of("int", F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("long")))
    v_double = of("float", value.try_cast("double"))
    v_bool = of("bool", F.lower(value).isin("true", "1", "t", "y", "yes"))
    v_json = of(("dict", "json", "list"), F.when(is_json(value), value))
    v_time = of("datetime", value.try_cast("timestamp"))
    v_decimal = of("decimal", value.try_cast("decimal(38,10)"))
    v_uuid = of("uuid", _uuid(value))
    v_address = of("url", F.when(V.is_url(value), value))
    v_mail = of("email", F.when(V.is_email(value), value))
    v_binary = of("binary", F.encode(value, "utf-8"))
    text = F.coalesce(v_int.cast("string"), v_bool.cast("string"), v_json, v_uuid, v_address, v_mail, F.when(~empty, value))
    typed = kind.isin("int", "float", "bool", "dict", "json", "list", "datetime", "uuid", "decimal", "url", "email", "binary")
    ok = empty | raw | ~F.coalesce(typed, F.lit(False)) | F.coalesce(v_int, v_double, v_bool.cast("int")).isNotNull() | F.coalesce(v_json, v_uuid, v_address, v_mail).isNotNull() | v_time.isNotNull() | v_decimal.isNotNull() | v_binary.isNotNull()
    return F.struct(v_int.alias("v_int"), v_double.alias("v_double"), v_bool.alias("v_bool"), v_json.alias("v_json"), v_time.alias("v_timestamp"), v_decimal.alias("v_decimal"), v_binary.alias("v_binary"), text.alias("v_str"), ok.alias("ok"))


def store_literal(value: Column, kind: Column) -> Column:
    """A text as a literal of a client-side model; a null kind is none of the named ones."""
    kind = F.coalesce(kind, F.lit(""))
    quoted = F.concat(F.lit("'"), value, F.lit("'"))
    return (
        F.when(value.isNull() | (F.lower(value) == "none"), F.lit("null"))
        .when(kind == "USER-DEFINED", quoted)
        .when(kind == "boolean", F.lower(value))
        .when(value == "", F.lit("''"))
        .when(value == "gen_random_uuid()", F.lit("uuidv4()"))
        .when((value == "[]") | (kind == "ARRAY"), value)
        .when(value.rlike(r"(?s)^\{.*\}$") | kind.isin("json", "jsonb"), F.coalesce(F.when(is_json(value), value), quoted))
        .when(kind.isin("bigint", "smallint", "integer", "real"), value)
        .otherwise(quoted)
    )


def test_value(kind: Column, seed: int = 7) -> Column:
    """A random text of a named type: a number below 100, one with two places at most, true or false, else 8 signs."""
    number = F.floor(F.rand(seed) * 100).cast("string")
    real = F.round(F.rand(seed + 1) * 100, 2).cast("string")
    return F.when(kind == "int", number).when(kind == "float", real).when(kind == "bool", (F.rand(seed + 2) < 0.5).cast("string")).otherwise(F.randstr(F.lit(8), F.lit(seed)))


def env_bool(c: Column) -> Column:
    """True and false by name, in any case; anything else is null."""
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)


def serializable(c: Column) -> Column:
    """Any value as JSON text; what isn't a JSON type becomes its text."""
    return F.to_json(F.struct(c.alias("value")))


# MIME types by extension.
MIME = {
    "txt": "text/plain", "html": "text/html", "css": "text/css", "csv": "text/csv", "md": "text/markdown", "js": "text/javascript", "json": "application/json",
    "xml": "text/xml", "pdf": "application/pdf", "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "mp3": "audio/mpeg", "wav": "audio/x-wav", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm",
    "avi": "video/x-msvideo", "mkv": "video/x-matroska", "py": "text/x-python", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def mime_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))[ext], F.lit("application/octet-stream"))


def cover_crop(w: Column, h: Column, to_w: int, to_h: int) -> Column:
    """struct<w, h, left, top>: the size that covers to_w x to_h at the image's ratio, and the crop's corner."""
    wide = w.cast("double") / h > F.lit(to_w / to_h)
    new_w = F.when(wide, F.floor(F.lit(to_h) * w.cast("double") / h)).otherwise(F.lit(to_w)).cast("int")
    new_h = F.when(wide, F.lit(to_h)).otherwise(F.floor(F.lit(to_w) * h.cast("double") / w)).cast("int")
    return F.struct(new_w.alias("w"), new_h.alias("h"), F.floor((new_w - to_w) / 2).cast("int").alias("left"), F.floor((new_h - to_h) / 2).cast("int").alias("top"))


def frame_index(frames: Column, position: Column) -> Column:
    return F.greatest(F.lit(0), (frames * position).cast("int"))


def megabytes(n: Column) -> Column:
    """Bytes as MB: whole from 1 on, else with one decimal, halves to even."""
    mb = n.cast("double") / F.lit(1024.0 * 1024.0)
    return F.when(mb >= 1, F.bround(mb, 0)).otherwise(F.bround(mb, 1))


_JSON_LINE = re.compile(r'( *)(?:("(?:[^"\\]|\\.)*"): )?(.*?)(,?)$')


def _literal(document, camel: bool) -> str:
    """Rewrites the lines of indented JSON: names without quotes where they may be, texts as they are, empty containers open."""
    out = []
    for line in json.dumps(document, indent=4).split("\n"):
        indent, key, value, comma = _JSON_LINE.fullmatch(line).groups()
        if key is not None:
            name = json.loads(key)
            name = camel_key(name) if camel else name
            key = (name if name.isidentifier() else f'"{name}"') + ": "
        if value.startswith('"'):
            value = f'"{json.loads(value)}"'
        elif value in ("{}", "[]"):
            value = f"{value[0]}\n{indent}    \n{indent}{value[1]}"
        out.append(f"{indent}{key or ''}{value}{comma}")
    return "\n".join(out)


def typescript_literal(c: Column, camel: bool = False) -> Column:
    """A JSON text as a TypeScript literal, four spaces a level; names are quoted where they must be, texts are not escaped.
    Null for what isn't JSON."""

    @F.pandas_udf("string")
    def literal(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else _literal(json.loads(text), camel)
            except ValueError:
                return None

        return texts.map(one)

    return literal(c)


def typescript_const(c: Column, name: str, camel: bool = True, export: bool = True, as_const: bool = False, kind: str | None = None) -> Column:
    head = f"{'export ' * export}const {name}{f': {kind}' if kind else ''} = "
    return F.concat(F.lit(head), typescript_literal(c, camel), F.lit(f"{' as const' * as_const};\n"))


def camel_key(name: str) -> str:
    """A name in camelCase: words begin at capitals and behind signs."""
    first, *rest = key_words(name)
    return first + "".join(w[:1].upper() + w[1:] for w in rest)


def key_words(name: str) -> list[str]:
    split = "".join("_" + ch if ch.isascii() and ch.isupper() and i else ch for i, ch in enumerate(name))
    clean = re.sub("_+", "_", "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in split).lower())
    return clean.split("_")
