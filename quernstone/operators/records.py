"""Record shaping by a declared list of fields, key changes, and generated class text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import case, convert

_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "list": "array<string>"}


@dataclass(frozen=True)
class Field:
    """kind: str, int, float, bool or list; of: the kind of a list's elements."""

    name: str
    kind: str = "str"
    of: str = "str"
    always: bool = False
    default: object = None


def _default(f: Field) -> Column:
    if f.default is None:
        return F.lit(None).cast("string")
    return F.lit(str(f.default).lower() if isinstance(f.default, bool) else str(f.default))


def _cast(c: Column, f: Field) -> Column:
    """A text as the field's kind; a failed conversion keeps the text.  bool is true for any text that isn't empty."""
    if f.kind == "int":
        return F.coalesce(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint").cast("string")), c)
    if f.kind == "float":
        return F.coalesce(c.try_cast("double").cast("string"), c)
    if f.kind == "bool":
        return F.when(c.isNull(), c).otherwise((c != "").cast("string"))
    return c


def _find(name: str, renames: list[tuple[str, str]], camel: bool) -> tuple[Column, Column]:
    """Whether a record has a key after the renames, and its value: a target has its source's value where that is there,
    else what it had before.  _v: the record; _snakes, _values: its keys with capitals in snake case, and all values."""
    if renames:
        *before, (source, target) = renames
        has, value = _find(name, before, camel)
        if name != target:
            return has, value
        moved, new = _find(source, before, camel)
        return moved | has, F.when(moved, new).otherwise(value)
    has, value = F.map_contains_key("_v", name), F.element_at(F.col("_v"), name)
    if not camel:
        return has, value
    at = F.array_position("_snakes", name)
    return has | (at > 0), F.when(has, value).otherwise(F.get("_values", (at - 1).cast("int")))


def shape(df: DataFrame, values: str, fields: list[Field], renames: dict[str, str] | None = None, camel: bool = False) -> DataFrame:
    """A text column for each field out of the map<string, string> column `values`, and `present`, the names that a
    record has.

    Keys with capitals first give copies in snake case where those are absent; then renames (source to target)
    overwrite.  A key that is absent takes its default if the field is always included and is left out else; the text
    "default" takes the default; a null stays; what can't be converted stays as it is.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base = df.withColumn("_v", F.coalesce(F.col(values), none))
    if camel:
        snakes = F.transform(F.map_keys("_v"), lambda k: F.when(k.rlike("[A-Z]"), case.snake_two_pass(k)).otherwise(""))
        base = base.withColumns({"_snakes": snakes, "_values": F.map_values("_v")})
    out, there = [], []
    for f in fields:
        has, raw = _find(f.name, list((renames or {}).items()), camel)
        wants = has & F.coalesce(raw == "default", F.lit(False))
        out.append(F.when(wants | (~has & F.lit(f.always)), _default(f)).when(has, _cast(raw, f)).alias(f.name))
        there.append(F.when((has & ~wants) | F.lit(f.always) | (wants & F.lit(f.default is not None)), F.lit(f.name)))
    return base.select(*(c for c in df.columns if c != values), *out, F.array_compact(F.array(*there)).alias("present"))


def convert_list(c: Column, of: str) -> Column:
    """Elements of an array of texts as int, bool or text, each kept as it is where it can't be converted."""
    return F.transform(c, lambda x: _cast(x, Field("", of)))


BASIC = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.NullType)


def not_basic(kind: T.DataType, path: str = "root") -> list[tuple[str, str]]:
    """(path, type) of what JSON has no type for, at any depth; keys of maps must be texts.  Spark's values have the types
    of their columns, so the schema tells it for all rows."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in not_basic(f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return not_basic(kind.elementType, f"{path}[]")
    if isinstance(kind, T.MapType):
        return [(f"{path}.key", kind.keyType.simpleString())] * (not isinstance(kind.keyType, T.StringType)) + not_basic(kind.valueType, f"{path}{{}}")
    return [] if isinstance(kind, BASIC) else [(path, kind.simpleString())]


def rename_keys(kind: T.DataType, change) -> T.DataType:
    """The same type with every struct field renamed by `change`, at any depth."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(change(f.name), rename_keys(f.dataType, change), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(rename_keys(kind.elementType, change), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, rename_keys(kind.valueType, change), kind.valueContainsNull)
    return kind


def keys_to_camel(df: DataFrame) -> DataFrame:
    """All columns and struct fields renamed to camelCase; no data moves."""
    kind = rename_keys(df.schema, convert.camel_key)
    return df.select(*(F.col(f"`{old.name}`").cast(new.dataType).alias(new.name) for old, new in zip(df.schema, kind, strict=True)))


def rename_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    kind = rename_keys(df.schema, lambda n: names.get(n, n))
    return df.select(*(F.col(f"`{old.name}`").cast(new.dataType).alias(new.name) for old, new in zip(df.schema, kind, strict=True)))


def without_terms(df: DataFrame, key: str, values: str, terms: tuple[str, ...]) -> DataFrame:
    """key, found: keys and values of a map<string, string> that hold none of the terms."""
    pieces = df.select(F.col(key), F.explode(values).alias("k", "v")).select(key, F.explode(F.array("k", "v")).alias("found"))
    keep = F.col("found").isNotNull()
    for t in terms:
        keep = keep & ~F.contains(F.col("found"), F.lit(t))
    return pieces.where(keep)


def merged_json(old: Column, new: Column) -> Column:
    """Keys of the new document replace those of the old one, whole lists included; map<string, string> columns."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def struct_of(fields: list[Field]) -> T.StructType:
    """The Spark type of a record with these fields."""
    return T.StructType([T.StructField(f.name, T._parse_datatype_string(_TYPES[f.kind] if f.kind != "list" else f"array<{_TYPES[f.of]}>"), not f.always) for f in fields])


def class_text(fields: DataFrame) -> DataFrame:
    """class, text: Python text of each data class: fields that must be given first, then the rest, and `to_dict`.

    fields: class, pos, name, kind, of, always, default (a Python literal; null for none), a row a field.
    """
    kind = F.when(F.col("kind") == "list", F.concat(F.lit("list["), "of", F.lit("]"))).otherwise(F.col("kind"))
    must = F.col("always") & F.col("default").isNull()
    given = F.when(F.col("kind") == "list", "None").otherwise(F.coalesce("default", F.lit("None")))
    line = F.concat(F.lit("    "), "name", F.lit(": "), kind, F.when(must, "").otherwise(F.concat(F.lit(" | None = "), given)))
    rows = fields.groupBy("class").agg(F.array_sort(F.collect_list(F.struct((~must).alias("later"), F.col("pos"), line.alias("line")))).alias("x"))
    head, tail = "from dataclasses import asdict, dataclass\n\n\n@dataclass\nclass ", "\n\n    def to_dict(self):\n        return {k: v for k, v in asdict(self).items() if v is not None}\n"
    return rows.select("class", F.concat(F.lit(head), "class", F.lit(":\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit(tail)).alias("text"))


def field_rows(name: str, fields: list[Field]) -> list[tuple]:
    """Rows of `class_text` for declared fields."""
    return [(name, i, f.name, f.kind, f.of, f.always, None if f.default is None else repr(f.default)) for i, f in enumerate(fields)]


FIELD_ROWS = "class string, pos int, name string, kind string, of string, always boolean, default string"


def files_json(files: DataFrame, path: str = "path") -> DataFrame:
    """dir, files: names in each folder, in order; one row a folder, nested by whoever writes the document."""
    return files.groupBy(F.regexp_replace(F.col(path), r"/?[^/]*$", "").alias("dir")).agg(F.array_sort(F.collect_list(F.regexp_extract(F.col(path), r"([^/]*)$", 1))).alias("files"))
