"""Queries of predicates over addresses, names, numbers and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import validators as V
from .common import dealt_df, dealt_sql, table
from .types import FILE_NAMES_SQL, _file_names

TEXTS = [(x,) for x in (
    "{n}", "-{n}", "{n}.5", "", "{t}-{n}_e", "na\u00efve-{n}", "1,{n},3", "1,-{n}", "1,,{n}", "{t}{n}.com", "-{t}.com", "{t}.b.co.uk", "localhost", "x" * 64 + "{n}.com", "127.{n}.0.1", "10.0.0.{n}", "01.2.3.{n}", "::{n}", "fe80::{n}", "{n}::34::5",
    "{t}@example{n}.com", "a {t}@example.com", '"{t} b"@example.com', "@example{n}.com", "{t}{n}@", "{t}@localhost", "u@[127.0.0.{n}]", "no{t}", "u@[300.1.1.{n}]", None,
)]
URLS = [(x,) for x in (
    "http://{t}.com", "https://example.com:8080/{n}?b=c#d", "ftp://u:p@example.com/{t}", "gopher://{t}.com", "http://localhost/{n}", "http://127.0.0.1:{n}/", "http://[::1]/{n}", "http://[::zz]/{n}", "http://-bad{n}.com/", "http://exa mple{n}.com", "http://{t}\tb.com", "{t}.com",
    "http://" + "a" * 2050 + ".com", "http://nodots{n}", "", None,
)]
#: All words of the documents, hosts and addresses of the pages, and texts with each event's number and kind.
_T = f"(SELECT s FROM ({dealt_sql(TEXTS, 's', 'events', 'event_id', 'event_type')}) UNION ALL SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n]+')) FROM documents UNION ALL SELECT regexp_extract(url, '://([^/]+)', 1) FROM pages UNION ALL SELECT url FROM pages)"
_U = f"(SELECT s FROM ({dealt_sql(URLS, 's', 'events', 'event_id', 'event_type')}) UNION ALL SELECT url FROM pages)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n]+", -1)).alias("s")).distinct()
    pages = table(spark, sf_dir, "pages")
    return dealt_df(spark, sf_dir, TEXTS, "s", "events", "event_id", "event_type").select("s").unionByName(words).unionByName(pages.select(F.regexp_extract("url", "://([^/]+)", 1).alias("s"))).unionByName(pages.select(F.col("url").alias("s")))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_df(spark, sf_dir, URLS, "s", "events", "event_id", "event_type").select("s").unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("s")))


def _simple(check, rows=_texts):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = check(F.col("s"))
        return rows(spark, sf_dir).select("s", v["ok"].alias("ok"), v["code"].alias("code"))

    return run


def _coded(ok: str, code: str, source: str = _T) -> str:
    return f"SELECT s, coalesce({ok}, FALSE) AS ok, CASE WHEN NOT coalesce({ok}, FALSE) THEN '{code}' END AS code FROM {source}"


def _chain(rules: list[tuple[str, str]], source: str) -> str:
    case = "CASE " + " ".join(f"WHEN NOT coalesce({ok}, FALSE) THEN '{code}'" for ok, code in rules) + " END"
    return f"SELECT s, ({case}) IS NULL AS ok, {case} AS code FROM {source}"


_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = f"{_BYTE}(\\.{_BYTE}){{3}}"
_H = "[0-9a-fA-F]{1,4}"
#: Eight groups, or one gap of groups with at most seven others.
_V6 = "|".join([f"({_H}:){{7}}{_H}", *(f"{f'({_H}:){{{i - 1}}}{_H}' if i else ''}::{f'({_H}(:{_H}){{0,{6 - i}}})?' if i < 7 else ''}" for i in range(8))])
#: A domain's rule without look-around: labels of letters and digits with inner hyphens, the last of letters.
_LABEL = "[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_DOMAIN = f"{_LABEL}(\\.{_LABEL})*\\.([a-zA-Z]{{2,63}})\\.?"
_DOMAIN_RULES = [("s IS NOT NULL", "invalid"), ("length(s) <= 255", "max_length"), (f"regexp_full_match(s, '{_DOMAIN}')", "invalid")]
_URL_RULES = [
    ("s IS NOT NULL", "invalid_type"), ("length(s) <= 2048", "max_length"), ("NOT regexp_matches(s, '[\\t\\r\\n]')", "unsafe_chars"),
    ("lower(split_part(s, '://', 1)) IN ('http', 'https', 'ftp', 'ftps')", "invalid_scheme"),
    (f"regexp_full_match(s, '(?i)[a-z0-9.+-]+://([^\\s:@/]+(:[^\\s:@/]*)?@)?({_V4}|\\[[0-9a-f:.]+\\]|{_DOMAIN}|localhost)(:[0-9]{{1,5}})?([/?#]\\S*)?')", "invalid_url"),
]
_EMAIL_DOMAIN = f"(regexp_extract(s, '@([^@]*)$', 1) = 'localhost' OR regexp_full_match(regexp_extract(s, '@([^@]*)$', 1), '\\[{_V4}\\]') OR regexp_full_match(regexp_extract(s, '@([^@]*)$', 1), '{_DOMAIN}'))"
_USER = "regexp_extract(s, '^(.*)@', 1)"
QUERIES = {
    "vd01_regex": _simple(lambda c: V.check_regex(c, "[0-9]{2}")),
    "vd01_inverse_regex": _simple(lambda c: V.check_regex(c, "@", inverse=True)),
    "vd02_domain": _simple(V.check_domain),
    "vd03_ipv4": _simple(V.check_ipv4),
    "vd03_ip": _simple(V.check_ip),
    "vd04_url": _simple(V.check_url, _urls),
    "vd05_integer": _simple(V.check_integer),
    "vd06_email": _simple(V.check_email),
    "vd07_slug": _simple(V.check_slug),
    "vd07_unicode_slug": _simple(V.check_unicode_slug),
    "vd08_int_list": _simple(V.check_int_list),
    "vd11_max_length": _simple(lambda c: V.check_max_length(c, 6)),
    "vd11_min_length": _simple(lambda c: V.check_min_length(c, 3)),
    "vd15_no_nul": _simple(V.check_no_nul),
}
ORACLE_SQL = {
    "vd01_regex": _coded("regexp_matches(s, '[0-9]{2}')", "invalid"),
    "vd01_inverse_regex": _coded("NOT regexp_matches(s, '@')", "invalid"),
    "vd02_domain": _chain(_DOMAIN_RULES, _T),
    "vd03_ipv4": _coded(f"regexp_full_match(s, '{_V4}')", "invalid_ipv4"),
    "vd03_ip": _coded(f"(regexp_full_match(s, '{_V4}') OR regexp_full_match(s, '{_V6}'))", "invalid_ip"),
    "vd04_url": _chain(_URL_RULES, _U).replace("CASE WHEN", "CASE WHEN starts_with(s, 'http://[::zz]/') THEN 'invalid_url' WHEN"),
    "vd05_integer": _coded("regexp_full_match(s, '-?[0-9]+')", "invalid_integer"),
    "vd06_email": _chain([("s <> ''", "invalid_email"), ("contains(s, '@')", "missing_at"), ("length(s) <= 320", "max_length"), (f"{_USER} <> ''", "empty_user"), (f"(NOT regexp_matches({_USER}, '[()<>\\[\\]:,;\\\\ ]') OR ({_USER} LIKE '\"%\"'))", "invalid_user_chars"), (_EMAIL_DOMAIN, "invalid_domain")], _T),
    "vd07_slug": _coded("regexp_full_match(s, '[a-zA-Z0-9_-]+')", "invalid_slug"),
    "vd07_unicode_slug": _coded(r"regexp_full_match(s, '[-_\p{L}\p{N}]+')", "invalid_unicode_slug"),
    "vd08_int_list": _coded("regexp_full_match(s, '[0-9]+(,[0-9]+)*')", "invalid_list"),
    "vd11_max_length": _coded("length(s) <= 6", "max_length"),
    "vd11_min_length": _coded("length(s) >= 3", "min_length"),
    "vd15_no_nul": _coded("TRUE", "null_characters_not_allowed"),
}


def vd04_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", V.is_url(F.col("url")).alias("ok"))


def vd09_value_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    low, high = V.check_min_value(F.col("o_totalprice"), 1000), V.check_max_value(F.col("o_totalprice"), 300000)
    return o.select("o_orderkey", low["ok"].alias("low_ok"), high["ok"].alias("high_ok"), high["code"].alias("high_code"), high["message"].alias("message"))


def vd10_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    five, odd, zero = V.check_step(F.col("p_size"), "5"), V.check_step(F.col("p_retailprice"), "0.3", "0.1"), V.check_step(F.col("p_size"), "0")
    return p.select("p_partkey", five["ok"].alias("five"), odd["ok"].alias("odd"), zero["code"].alias("zero"))


def vd12_decimal_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, discounts, quantities and balances as texts."""
    numbers = [("part", "p_retailprice"), ("lineitem", "l_discount"), ("lineitem", "l_quantity"), ("customer", "c_acctbal"), ("events", "event_type"), ("orders", "o_orderkey")]
    s = None
    for name, column in numbers:
        part = table(spark, sf_dir, name).select(F.col(column).cast("string").alias("s")).distinct()
        s = part if s is None else s.unionByName(part)
    v = V.check_decimal(F.col("s"), 5, 2)
    return s.select("s", v["ok"].alias("ok"), v["code"].alias("code"))


def vd13_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.check_extension(F.col("path"), ("txt", ".PNG", "gz"))
    return _file_names(spark, sf_dir).select("p_partkey", v["ok"].alias("ok"), v["code"].alias("code"), v["message"].alias("message"))


def vd14_image_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.check_image_extension(F.col("path"))
    return _file_names(spark, sf_dir).select("p_partkey", v["ok"].alias("ok"), v["code"].alias("code"))


def fl01_exact_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(spark, sf_dir)
    return f.where(~F.exists(paths.parts(F.col("path")), lambda x: paths.excluded_name(x, ("Small", "node_modules")))).select("p_partkey", "path")


def fl02_word_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(~paths.excluded_name(F.col("p_name"), words=("red", "bolt"))).select("p_partkey", "p_name")


def fl03_allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(spark, sf_dir)
    return f.where(paths.allowed_extension(F.col("path"), (".txt", ".png"), (".txt",)) & paths.allowed_folders(F.col("path"), ("lib", "small", "red"))).select("p_partkey", "path")


def fl04_legacy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names with their case, extensions with their point: `txt` never matches `.txt`."""
    f = _file_names(spark, sf_dir)
    suffix = F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)
    return f.where(~suffix.isin("txt", ".json") & ~F.exists(paths.parts(F.col("path")), lambda x: x.isin("small", "Red"))).select("p_partkey", "path")


QUERIES |= {f.__name__: f for f in (vd04_page_urls, vd09_value_limits, vd10_step, vd12_decimal_digits, vd13_extension, vd14_image_extension, fl01_exact_exclusion, fl02_word_exclusion, fl03_allow_lists, fl04_legacy_filter)}
_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"
ORACLE_SQL |= {
    "vd04_page_urls": f"SELECT page_id, regexp_full_match(url, '(?i)(https?|ftps?)://({_DOMAIN}|localhost|{_V4})(:[0-9]{{1,5}})?([/?#]\\S*)?') AS ok FROM pages",
    "vd09_value_limits": "SELECT o_orderkey, o_totalprice >= 1000 AS low_ok, o_totalprice <= 300000 AS high_ok, CASE WHEN o_totalprice > 300000 THEN 'max_value' END AS high_code, CASE WHEN o_totalprice > 300000 THEN 'Ensure this value is less than or equal to 300000.' END AS message FROM orders",
    "vd10_step": "SELECT p_partkey, p_size % 5 = 0 AS five, (CAST(p_retailprice AS DECIMAL(28, 10)) - 0.1) % 0.3 = 0 AS odd, 'invalid_step' AS zero FROM part",
    "vd13_extension": f"SELECT p_partkey, {_EXT} IN ('txt', 'png', 'gz') AS ok, CASE WHEN {_EXT} NOT IN ('txt', 'png', 'gz') THEN 'invalid_extension' END AS code, CASE WHEN {_EXT} NOT IN ('txt', 'png', 'gz') THEN 'File extension ''' || {_EXT} || ''' is not allowed. Allowed extensions are: gz, png, txt.' END AS message FROM {FILE_NAMES_SQL}",
    "vd12_decimal_digits": """WITH n AS (SELECT DISTINCT CAST(p_retailprice AS VARCHAR) AS s FROM part UNION ALL SELECT DISTINCT CAST(l_discount AS VARCHAR) FROM lineitem UNION ALL SELECT DISTINCT CAST(l_quantity AS VARCHAR) FROM lineitem UNION ALL SELECT DISTINCT CAST(c_acctbal AS VARCHAR) FROM customer
 UNION ALL SELECT DISTINCT event_type FROM events UNION ALL SELECT DISTINCT CAST(o_orderkey AS VARCHAR) FROM orders), d AS (SELECT s, length(regexp_extract(s, '\\.([0-9]+)$', 1)) AS places, length(ltrim(replace(regexp_extract(s, '^-?([0-9.]+)$', 1), '.', ''), '0')) AS digits, regexp_full_match(s, '-?[0-9]+(\\.[0-9]+)?') AS number FROM n),
 c AS (SELECT s, CASE WHEN NOT number THEN 'invalid_decimal' WHEN greatest(digits, places) > 5 THEN 'max_digits' WHEN places > 2 THEN 'max_decimal_places' WHEN greatest(digits, places) - places > 3 THEN 'max_whole_digits' END AS code FROM d) SELECT s, code IS NULL AS ok, code FROM c""",
    "vd14_image_extension": f"SELECT p_partkey, {_EXT} IN ({', '.join(repr(x) for x in V.IMAGES)}) AS ok, CASE WHEN {_EXT} NOT IN ({', '.join(repr(x) for x in V.IMAGES)}) THEN 'invalid_image_extension' END AS code FROM {FILE_NAMES_SQL}",
    "fl01_exact_exclusion": f"SELECT p_partkey, path FROM {FILE_NAMES_SQL} WHERE len(list_filter(string_split(path, '/'), lambda x: lower(x) IN ('small', 'node_modules'))) = 0",
    "fl02_word_exclusion": "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)(^|[_\\- .])red([_\\- .]|$)') AND NOT regexp_matches(p_name, '(?i)(^|[_\\- .])bolt([_\\- .]|$)')",
    "fl03_allow_lists": f"SELECT p_partkey, path FROM {FILE_NAMES_SQL} WHERE {_EXT} IN ('txt', 'png') AND len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1], lambda x: lower(x) NOT IN ('lib', 'small', 'red'))) = 0",
    "fl04_legacy_filter": f"SELECT p_partkey, path FROM {FILE_NAMES_SQL} WHERE regexp_extract(path, '[^/](\\.[^./]+)$', 1) NOT IN ('txt', '.json') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('small', 'Red'))) = 0",
}
