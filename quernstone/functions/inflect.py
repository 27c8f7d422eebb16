"""English plurals and singulars by ordered rules; the first rule that matches is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without a plural, irregular words, and the rules in their order ($1 is the first group).
UNCOUNTABLE = ("equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "deer", "aircraft", "data", "media", "news", "staff", "police", "traffic")
IRREGULAR = {
    "person": "people", "man": "men", "woman": "women", "child": "children", "foot": "feet", "tooth": "teeth", "goose": "geese", "mouse": "mice", "ox": "oxen",
    "index": "indices", "matrix": "matrices", "vertex": "vertices", "axis": "axes", "analysis": "analyses", "basis": "bases", "crisis": "crises",
    "diagnosis": "diagnoses", "hypothesis": "hypotheses", "parenthesis": "parentheses", "thesis": "theses", "datum": "data", "medium": "media",
    "criterion": "criteria", "phenomenon": "phenomena", "schema": "schemas", "status": "statuses",
}
PLURAL = (
    (r"(quiz)$", "$1zes"), (r"^(oxen)$", "$1"), (r"^(ox)$", "$1en"), (r"(m|l)ice$", "$1ice"), (r"(m|l)ouse$", "$1ice"), (r"(pea)ple$", "$1ple"),
    (r"(child)ren$", "$1ren"), (r"(x|ch|ss|sh)es$", "$1es"), (r"(x|ch|ss|sh)$", "$1es"), (r"([^aeiouy]|qu)ies$", "$1ies"), (r"([^aeiouy]|qu)y$", "$1ies"),
    (r"(hive|archive|love|move|prove|live)s$", "$1s"), (r"(buffal|tomat|volcan|her|potat|tornad)oes$", "$1oes"), (r"(buffal|tomat|volcan|her|potat|tornad)o$", "$1oes"),
    (r"(bu|mis|gas)ses$", "$1ses"), (r"(bu|mis|gas)s$", "$1ses"), (r"(s)tatus$", "$1tatuses"), (r"(s)tatuses$", "$1tatuses"),
    (r"(alias|status|campus|apparatus|virus|walrus)es$", "$1es"), (r"(alias|campus|apparatus|virus|walrus)$", "$1es"), (r"(ax|test|crisis)es$", "$1es"),
    (r"(octop|syllab|cact|foc|hippopotam|radi|stimul|alumn|bacill|curr|fung|nucle|termin)i$", "$1i"),
    (r"(octop|syllab|cact|foc|hippopotam|radi|stimul|alumn|bacill|curr|fung|nucle|termin)us$", "$1i"), (r"(ax|cris|test)is$", "$1es"),
    (r"(vert|ind)(ex|ices)$", "$1ices"), (r"(vert|ind)ex$", "$1ices"), (r"([lr])ves$", "$1ves"), (r"([lr])f$", "$1ves"), (r"([^f])ves$", "$1ves"), (r"([ti])a$", "$1a"),
    (r"((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)ses$", "$1ses"), (r"((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)sis$", "$1ses"),
    (r"(analy)sis$", "$1ses"), (r"([^aeious])s$", "$1s"), (r"s$", "s"), (r"$", "s"),
)
SINGULAR = (
    (r"(quiz)zes$", "$1"), (r"(matr)ices$", "$1ix"), (r"(vert|ind)(ex|ices)$", "$1ex"), (r"^(ox)en", "$1"), (r"(alias|status|campus|apparatus|virus|walrus)es$", "$1"),
    (r"(octop|syllab|cact|foc|hippopotam|radi|stimul|alumn|bacill|curr|fung|nucle|termin)i$", "$1us"), (r"(cris|test|ax)es$", "$1is"), (r"(shoe)s$", "$1"),
    (r"(o)es$", "$1"), (r"(bus)ses$", "$1"), (r"([m|l])ice$", "$1ouse"), (r"(x|ch|ss|sh)es$", "$1"), (r"(m)ovies$", "$1ovie"), (r"(s)eries$", "$1eries"),
    (r"([^aeiouy]|qu)ies$", "$1y"), (r"([lr])ves$", "$1f"), (r"(thi|shea|lea)ves$", "$1f"), (r"(s)tatus(es)?$", "$1tatus"),
    (r"(analy|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)ses$", "$1sis"), (r"([ti])a$", "$1um"), (r"(p)eople$", "$1erson"), (r"(child)ren$", "$1"),
    (r"(n)ews$", "$1ews"), (r"s$", ""),
)


def _inflected(c: Column, irregular: dict[str, str], rules: tuple, otherwise: Column) -> Column:
    low = F.lower(c)
    out = F.when(c == "", c).when(low.isin(*UNCOUNTABLE), c)
    found = F.create_map(*(F.lit(x) for pair in irregular.items() for x in pair))[low]
    out = out.when(found.isNotNull(), F.when(F.substring(c, 1, 1) != F.lower(F.substring(c, 1, 1)), F.concat(F.upper(F.substring(found, 1, 1)), F.substr(found, F.lit(2)))).otherwise(found))
    for pattern, to in rules:
        out = out.when(c.rlike("(?i)" + pattern), F.regexp_replace(c, "(?i)" + pattern, to))
    return out.otherwise(otherwise)


def plural(c: Column) -> Column:
    return _inflected(c, IRREGULAR, PLURAL, F.concat(c, F.lit("s")))


def singular(c: Column) -> Column:
    return _inflected(c, {many: one for one, many in IRREGULAR.items()}, SINGULAR, c)
