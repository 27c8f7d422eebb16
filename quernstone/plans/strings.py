"""Queries of text functions over part names, customer names and texts of all edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import case, clean, inflect, paths
from .common import dealt_df, dealt_sql, table, values_df, values_sql

EDGES = [(x,) for x in (
    "ABC", "a1b", "HTTPServer", "XML http-Req", "_x", "x_", "a__b", " lead", "AISettings2Go", "getHTTPResponseCode", "person", "Quiz", "box", "Analysis", "status", "cities", "city", "wolves", "wolf", "Ox",
    "data", "tomato", "knives", "bus", "buses", "mice", "mouse", "axes", "Matrix", "matrices", "series", "child", "children", "12abc", "a.b-c", "9", "-", "Hello World, again!", "hive", "octopus", "radii", "virus", "viruses",
    "news", "analyses", "day", "dish", "dishes", "potatoes", "criterion", "leaves", "shelf", "schema", "a/b/../c/./D", "..\\x\\y", "/r/../../q", "requests[security]>=2.0 ; x", "Num-Py==1.2", "first-page-name", "<b>bold</b> text", "short", "exactly8", "sixteen-letters!", None, "",
)]
BASE_SQL = f"(SELECT p_name AS s FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_brand FROM part UNION ALL {values_sql(EDGES, 's')})"
SNAKE = r"lower(regexp_replace(left(s, 1) || regexp_replace(substr(s, 2), '([A-Z])', '_\1', 'g'), '[^a-zA-Z0-9]+', '_', 'g'))"


def _titled(x: str) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({x}, '[a-z]+|[^a-z]+'), lambda r: upper(r[1]) || r[2:]), ''), '')"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("s")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("s"))).unionByName(part.select(F.col("p_brand").alias("s")))
    return names.unionByName(values_df(spark, EDGES, "s"))


def _rules(rules: tuple) -> str:
    return " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN regexp_replace(s, '(?i){p}', '{t.replace('$1', chr(92) + '1')}', 'g')" for p, t in rules)


def _inflect_sql(irregular: dict, rules: tuple, otherwise: str) -> str:
    words = ", ".join(f"'{w}'" for w in inflect.UNCOUNTABLE)
    known = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in irregular.items()) + "}"
    hit = f"{known}[lower(s)]"
    return f"CASE WHEN s IS NULL OR s = '' OR lower(s) IN ({words}) THEN s WHEN {hit} IS NOT NULL THEN CASE WHEN left(s, 1) <> lower(left(s, 1)) THEN upper(left({hit}, 1)) || substr({hit}, 2) ELSE {hit} END {_rules(rules)} ELSE {otherwise} END"


_PRETTY = _titled(r"lower(left(replace(s, '_', ' '), 1) || regexp_replace(substr(replace(s, '_', ' '), 2), '([A-Z])', ' \1', 'g'))")
_REDACT = "CASE WHEN length(s) <= 4 THEN repeat('*', length(s)) WHEN length(s) <= 8 THEN left(s, 1) || repeat('*', length(s) - 2) || right(s, 1) WHEN length(s) <= 16 THEN left(s, 2) || repeat('*', length(s) - 4) || right(s, 2) ELSE left(s, 3) || repeat('*', length(s) - 6) || right(s, 3) END"
_SENSITIVE = "(password|secret|key|token|auth|credential|private|pass|pwd|api_key|access_key|secret_key)"
_NORMAL = (
    "CASE WHEN s IS NULL THEN NULL ELSE (SELECT CASE WHEN x = '' THEN '.' ELSE x END FROM (SELECT lower(CASE WHEN left(replace(s, '\\', '/'), 1) = '/' THEN '/' ELSE '' END || array_to_string(list_reduce("
    "list_transform(string_split(replace(s, '\\', '/'), '/'), lambda p: [p]), lambda d, p: CASE WHEN p[1] IN ('', '.') THEN d WHEN p[1] = '..' THEN CASE WHEN len(d) > 0 AND d[len(d)] <> '..' THEN d[1:len(d) - 1] "
    "WHEN left(replace(s, '\\', '/'), 1) = '/' THEN d ELSE list_append(d, '..') END ELSE list_append(d, p[1]) END, CAST([] AS VARCHAR[])), '/')) AS x)) END"
)
#: name: (Column of s, SQL of s)
SCALARS: dict[str, tuple] = {
    "st01_lower": (F.lower, "lower(s)"),
    "st01_upper": (F.upper, "upper(s)"),
    "st02_snake_case": (case.snake, SNAKE),
    "st03_kebab_case": (case.kebab, f"replace({SNAKE}, '_', '-')"),
    "st03_dot_notation": (case.dotted, f"replace({SNAKE}, '_', '.')"),
    "st03_constant_case": (case.constant, f"upper({SNAKE})"),
    "st03_space_case": (case.spaced, f"replace({SNAKE}, '_', ' ')"),
    "st04_pascal_case": (case.pascal, f"CASE WHEN s IS NOT NULL THEN replace({_titled(SNAKE)}, '_', '') END"),
    "st04_title_case": (case.title, f"CASE WHEN s IS NOT NULL THEN replace({_titled(SNAKE)}, '_', ' ') END"),
    "st05_camel_case": (case.camel, f"CASE WHEN s IS NOT NULL THEN split_part({SNAKE}, '_', 1) || replace({_titled(f'CASE WHEN contains({SNAKE}, chr(95)) THEN substr({SNAKE}, instr({SNAKE}, chr(95))) ELSE chr(95) END')}, '_', '') END"),
    "st06_plural": (inflect.plural, _inflect_sql(inflect.IRREGULAR, inflect.PLURAL, "s || 's'")),
    "st07_singular": (inflect.singular, _inflect_sql({b: a for a, b in inflect.IRREGULAR.items()}, inflect.SINGULAR, "s")),
    "st08_acronym": (case.acronym, r"CASE WHEN s IS NOT NULL THEN upper(array_to_string(regexp_extract_all(replace(s, '_', ' '), '\b\w'), '')) END"),
    "st09_plain": (case.plain, "regexp_replace(s, '[^a-zA-Z0-9_]', '', 'g')"),
    "st09_identifier": (case.identifier, "CASE WHEN regexp_matches(regexp_replace(s, '[^a-zA-Z0-9_]', '', 'g'), '^[0-9]') THEN '_' || regexp_replace(s, '[^a-zA-Z0-9_]', '', 'g') ELSE regexp_replace(s, '[^a-zA-Z0-9_]', '', 'g') END"),
    "st10_quoted": (case.quoted, "'\"' || s || '\"'"),
    "st10_comment_html": (lambda c: case.comment(c, "html"), "'<!-- ' || s || ' -->'"),
    "st10_comment_css": (lambda c: case.comment(c, "css"), "'/* ' || s || ' */'"),
    "st10_url_slug": (case.url_slug, "trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-')"),
    "st11_pretty_name": (case.pretty, f"CASE WHEN s IS NOT NULL THEN {_PRETTY} END"),
    "st12_snake_two_pass": (case.snake_two_pass, r"lower(regexp_replace(regexp_replace(s, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'))"),
    "st14_clean_text": (lambda c: clean.clean_text(c, True, True, compatibility=False), r"trim(regexp_replace(regexp_replace(s, '<[^>]+>', '  ', 'g'), '\s+', ' ', 'g'))"),
    "st15_strip_tags": (clean.strip_tags, "regexp_replace(s, '<[^>]+>', '  ', 'g')"),
    "st16_ascii_only": (clean.ascii_only, r"regexp_replace(s, '[^\x00-\x7F]+', '', 'g')"),
    "st17_redact": (clean.redact, _REDACT),
    "st22_label": (case.label, "upper(left(replace(s, '-', ' '), 1)) || lower(substr(replace(s, '-', ' '), 2))"),
    "st22_word_labels": (case.word_labels, "CASE WHEN s IS NOT NULL THEN array_to_string(list_transform(string_split(s, '-'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') END"),
    "st23_package_name": (case.package_name, "lower(replace(s, '-', '_'))"),
    "st24_path_normal": (paths.normal, _NORMAL),
    "ty23_requirement_name": (case.requirement_name, r"CASE WHEN s IS NOT NULL THEN lower(replace(regexp_extract(trim(s), '^[^>=<!;\s\[]*'), '-', '_')) END"),
    "so09_truncated": (lambda c: clean.truncated(c, 12), "CASE WHEN length(s) > 12 THEN left(s, 12) END"),
}


def _scalar(f) -> object:
    return lambda spark, sf_dir: base(spark, sf_dir).select("s", f(F.col("s")).alias("out"))


QUERIES = {name: _scalar(f) for name, (f, _) in SCALARS.items()}
ORACLE_SQL = {name: f"SELECT s, {sql} AS out FROM {BASE_SQL}" for name, (_, sql) in SCALARS.items()}


def st13_acronym_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("s", case.acronym_snake(F.col("s")).alias("out"))


def st14_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With compatibility forms; SQL has only the canonical ones, which are the same for these texts."""
    return table(spark, sf_dir, "documents").select("doc_id", clean.clean_text(F.col("text"), True, True).alias("out"))


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("api_key"), F.concat(F.lit("secret-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type"))).alias("m"))


def st18_redact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = clean.redact_map(F.col("m"))
    return _props(spark, sf_dir).select("event_id", m["k"].alias("k"), m["api_key"].alias("api_key"))


def st18_redact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", clean.redact_json(F.concat(F.lit('{"auth": "token-value-of-user", "in": '), F.col("props"), F.lit("}"))).alias("out"))


def st19_union_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("v")).select("p_brand", case.union_text(F.col("v")).alias("out"))


def fl09_sensitive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(clean.is_sensitive(F.concat("s", F.lit("-key")))).select("s", clean.is_sensitive(F.col("s")).alias("out"))


def fl10_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = dealt_df(spark, sf_dir, BLANKS, "s", "events", "event_id", "props")
    return blank.select("id", "s", clean.is_blank_json(F.col("s")).alias("out"))


BLANKS = [("",), (None,), ("[]",), ("{}",), ('{"a{n}": ""}',), ('{"a": [null, {}]}',), ("{t}",), ("[{n}]",), ('["x{n}"]',), ('[{"b": {t}}]',), ('{"a": [{}, "", {"b": null}]}',)]
QUERIES |= {"st13_acronym_snake": st13_acronym_snake, "st14_clean_documents": st14_clean_documents, "st18_redact_map": st18_redact_map, "st18_redact_json": st18_redact_json, "st19_union_text": st19_union_text, "fl09_sensitive_key": fl09_sensitive_key, "fl10_blank": fl10_blank}
_S = "('secret-' || user_id || '-' || event_type)"
ORACLE_SQL |= {
    "st13_acronym_snake": f"SELECT s, lower(regexp_replace(regexp_replace(s, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS out FROM {BASE_SQL}",
    "st14_clean_documents": r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '<[^>]+>', '  ', 'g'), '\s+', ' ', 'g')) AS out FROM documents",
    "st18_redact_json": """SELECT event_id, '{"auth": "tok*************ser", "in": {"k": ' || json_extract_string(props, '$.k') || '}}' AS out FROM events""",
    "st18_redact_map": f"SELECT event_id, json_extract_string(props, '$.k') AS k, {_REDACT.replace('(s', '(' + _S)} AS api_key FROM events",
    "st19_union_text": "SELECT p_brand, array_to_string(list_transform(list_sort(list(DISTINCT p_name)), lambda v: '\"' || regexp_replace(v, '[^a-zA-Z0-9_]', '', 'g') || '\"'), ' | ') AS out FROM part GROUP BY p_brand",
    "fl09_sensitive_key": f"SELECT s, regexp_matches(lower(s), '{_SENSITIVE}') AS out FROM {BASE_SQL} WHERE s IS NOT NULL",
    "fl10_blank": f"SELECT id, s, id % {len(BLANKS)} IN (0, 1, 2, 3, 4, 5, 10) AS out FROM ({dealt_sql(BLANKS, 's', 'events', 'event_id', 'props')})",
}
