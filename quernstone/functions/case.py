"""Case conversion. A null stays null; letters are ASCII where words are split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake(c: Column) -> Column:
    """A `_` before every capital but a first one, runs of other signs to one `_`, small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?<!^)(?=[A-Z])", "_"), r"[^a-zA-Z0-9]+", "_"))


def _titled(token: Column) -> Column:
    """A capital at each letter that no letter precedes; tokens hold a-z and 0-9 only."""
    return F.replace(F.initcap(F.regexp_replace(token, r"([0-9])([a-z])", "$1 $2")), F.lit(" "), F.lit(""))


def _tokens(c: Column) -> Column:
    return F.split(snake(c), "_", -1)


def kebab(c: Column) -> Column:
    return F.translate(snake(c), "_", "-")


def dotted(c: Column) -> Column:
    return F.translate(snake(c), "_", ".")


def constant(c: Column) -> Column:
    return F.upper(snake(c))


def spaced(c: Column) -> Column:
    return F.translate(snake(c), "_", " ")


def pascal(c: Column) -> Column:
    return F.array_join(F.transform(_tokens(c), _titled), "")


def title(c: Column) -> Column:
    return F.array_join(F.transform(_tokens(c), _titled), " ")


def camel(c: Column) -> Column:
    t = _tokens(c)
    return F.concat(F.element_at(t, 1), F.array_join(F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), _titled), ""))


def snake_two_pass(c: Column) -> Column:
    """The second algorithm: HTTPServer gives http_server."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(.)([A-Z][a-z]+)", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))


def acronym_snake(c: Column) -> Column:
    """The third algorithm, for names of letters, digits and `_`: a `_` before a capital that follows a small letter or
    a digit, or that ends a run of capitals before a small letter."""
    return F.lower(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def acronym(c: Column) -> Column:
    """The first sign of each word, in capitals."""
    return F.upper(F.array_join(F.regexp_extract_all(F.translate(c, "_", " "), F.lit(r"\b(\w)"), 1), ""))


def plain(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_]", "")


def identifier(c: Column) -> Column:
    p = plain(c)
    return F.when(p.rlike("^[0-9]"), F.concat(F.lit("_"), p)).otherwise(p)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


#: Comment signs before and after a text.
COMMENTS = {"python": ("# ", ""), "javascript": ("// ", ""), "html": ("<!-- ", " -->"), "css": ("/* ", " */")}


def comment(c: Column, language: str = "python") -> Column:
    before, after = COMMENTS.get(language.lower(), COMMENTS["python"])
    return F.concat(F.lit(before), c, F.lit(after))


def url_slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def pretty(c: Column) -> Column:
    """`_` to a space, a space before each capital but a first one, then titles; ASCII letters."""
    spread = F.regexp_replace(F.translate(c, "_", " "), r"(?<!^)(?=[A-Z])", " ")
    marked = F.regexp_replace(F.lower(spread), r"([^a-z ])([a-z])", "$1\u0001 $2")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def label(c: Column) -> Column:
    """`-` to a space; the first sign a capital, the rest small."""
    s = F.translate(c, "-", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def word_labels(c: Column) -> Column:
    """As `label`, for each word between `-`."""
    return F.array_join(F.transform(F.split(c, "-", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def union_text(values: Column, separator: str = " | ") -> Column:
    """Quoted identifiers of the texts that aren't empty; no such text: empty."""
    return F.array_join(F.transform(F.filter(values, lambda v: v != ""), lambda v: quoted(identifier(v))), separator)


def package_name(c: Column) -> Column:
    return F.lower(F.translate(c, "-", "_"))


def requirement_name(c: Column) -> Column:
    """The package that a requirement line names."""
    return package_name(F.element_at(F.split(F.trim(c), r"[>=<!;\s\[]", 2), 1))


