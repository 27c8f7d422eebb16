"""Paths as texts: parts, ancestors and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda x: x != "")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The small last suffix with its point; none: empty."""
    return F.lower(F.regexp_extract(basename(path), r"[^/](\.[^./]+)$", 1))


def ancestors(path: Column) -> Column:
    """Folders above a file from the top down."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def normal(path: Column) -> Column:
    """`.` and `..` folded, `\\` to `/`, small letters; nothing left: `.`."""
    slashed = F.translate(path, "\\", "/")
    rooted = slashed.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(slashed, "/", -1), F.array().cast("array<string>"), step), "/")
    out = F.lower(F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), folded))
    return F.when(out == "", F.lit(".")).otherwise(out)


def generated_name(sub: Column, prefix: Column, suffix: Column, ext: str, stamp: Column) -> Column:
    """sub/prefix_yyyyMMdd_HHmmss_suffix.ext; empty parts are left out."""
    named = F.array_join(F.filter(F.array(prefix, F.date_format(stamp, "yyyyMMdd_HHmmss"), suffix), lambda x: x.isNotNull() & (x != "")), "_")
    return F.concat(F.when(F.coalesce(sub, F.lit("")) != "", F.concat(sub, F.lit("/"))).otherwise(F.lit("")), named, F.lit(f".{ext}"))


def excluded_name(name: Column, exact: tuple[str, ...] = (), words: tuple[str, ...] = ()) -> Column:
    """Names equal to one of `exact` in any case, or with one of `words` between `_`, `-`, `.`, spaces and the ends."""
    out = F.lower(name).isin(*(x.lower() for x in exact)) if exact else F.lit(False)
    for w in words:
        out = out | name.rlike(rf"(?i)(^|[_\- .])\Q{w}\E([_\- .]|$)")
    return out


def allowed_extension(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """A list of allowed extensions overrides the list of excluded ones; both empty: all."""
    ext = extension(path)
    if include:
        return ext.isin(*(x.lower() for x in include))
    return ~ext.isin(*(x.lower() for x in exclude)) if exclude else F.lit(True)


def allowed_folders(path: Column, allowed: tuple[str, ...]) -> Column:
    """Every folder above the file is allowed; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    p = parts(path)
    return F.forall(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.lower(x).isin(*(a.lower() for a in allowed)))


def resolved(root: Column, path: Column) -> Column:
    """A path under a root, with `.` and `..` folded; `..` may leave the root."""
    every = F.split(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path), "/", -1)
    last = lambda done: F.try_element_at(done, F.lit(-1))

    def fold(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & ~F.coalesce(last(done).isin("", ".."), F.lit(True))
        skip = part.isin("", ".") & (F.size(done) > 0)
        return F.when(back, F.slice(done, F.lit(1), F.size(done) - 1)).when(skip, done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(every, F.array().cast("array<string>"), fold), "/")
