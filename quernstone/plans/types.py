"""Queries of type names, values, addresses and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, paths, types, urls
from ..operators import access
from .common import dealt_df, dealt_sql, table

NAMES = [(x,) for x in (*types.type_map("field"), "int2", "string", "column_name", "mood", "UUID", "nothing", None, "Date", "CharField", "{t}", "x{n}")]
ENUMS = ("mood",)


def _map(target: str) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in types.type_map(target, ENUMS).items()) + "}"


def _mapped(target: str) -> str:
    known = ", ".join(f"'{x}'" for x in sorted({*types.type_map(target, ENUMS).values(), "column_name"}))
    a, b = types.MISS[target]
    return f"coalesce({_map(target)}[s], CASE WHEN s IN ({known}) THEN s END, '{a}' || coalesce(s, 'None') || '{b}')"


SCALARS = {
    "ty01_typescript_type": (lambda c: types.mapped_type(c, "typescript", ENUMS), _mapped("typescript")),
    "ty01_schema_type": (lambda c: types.mapped_type(c, "schema", ENUMS), _mapped("schema")),
    "ty01_model_field": (lambda c: types.mapped_type(c, "field", ENUMS), _mapped("field")),
    "ty02_python_type": (lambda c: types.python_type(c, ENUMS), f"CASE WHEN s IS NOT NULL THEN coalesce({_map('python')}[lower(s)], 'Any') END"),
    "ty02_annotation": (lambda c: types.annotation(c, "typescript", ENUMS), f"CASE WHEN s IS NOT NULL THEN coalesce({_map('typescript')}[lower(s)], 'any') END"),
    "ty02_legacy_typescript": (lambda c: types.legacy_typescript_type(c, ENUMS), f"{_map('typescript')}[lower(s)]"),
    "ty03_enum_types": (lambda c: types.mapped_type(c, "field", (*ENUMS, "nothing")), _mapped("field").replace("MAP {", "MAP {'nothing': 'CharField', ")),
}
#: Names of types dealt to parts, with their own type's and number among them.
_NAMES = ("part", "p_partkey", "p_type")
QUERIES = {name: (lambda f: lambda spark, sf_dir: dealt_df(spark, sf_dir, NAMES, "s", *_NAMES).select("id", "s", f(F.col("s")).alias("out")))(f) for name, (f, _) in SCALARS.items()}
ORACLE_SQL = {name: f"SELECT id, s, {sql} AS out FROM ({dealt_sql(NAMES, 's', *_NAMES)})" for name, (_, sql) in SCALARS.items()}

VALUES = [("{n}", "int"), (" {n} ", "int"), ("x{n}", "int"), ("{n}.5", "float"), ("abc{n}", "float"), ("true", "bool"), ("Y", "bool"), ("no{n}", "bool"), ("", "int"), ("null", "str"), ("NULL", "json"), (None, "int"), ("{a{n}}!", "int"), ("{t}", "json"), ("{bad{n}", "dict"), ("[{n}]", "list"), ("{t}", "str"), ("{n}", None), ("q", "blank"), ("{t}", "other"), ("[{t}, {n}]", "json"), ("{t}x", "json")]
_EVENTS = ("events", "event_id", "props")


def ty04_convert_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = convert.convert(F.col("value"), F.col("data_type"))
    return dealt_df(spark, sf_dir, VALUES, "value, data_type", *_EVENTS).select("id", "value", "data_type", v["v_int"].alias("v_int"), v["v_double"].alias("v_double"), v["v_bool"].alias("v_bool"), v["v_str"].alias("v_str"), v["ok"].alias("ok"))


_EMPTY = "(value IS NULL OR value IN ('', 'null', 'NULL'))"
_LIVE = f"(NOT {_EMPTY} AND NOT regexp_full_match(value, '\\{{.*\\}}!'))"
_JSON_OK = "(data_type IN ('dict', 'json', 'list') AND json_valid(value))"
ORACLE_SQL["ty04_convert_value"] = (
    f"SELECT id, value, data_type, v_int, v_double, v_bool, CASE WHEN {_EMPTY} THEN NULL ELSE coalesce(CAST(v_int AS VARCHAR), CAST(v_bool AS VARCHAR), value) END AS v_str, "
    f"{_EMPTY} OR NOT {_LIVE} OR coalesce(data_type NOT IN ('int', 'float', 'bool', 'dict', 'json', 'list'), TRUE) OR v_int IS NOT NULL OR v_double IS NOT NULL OR v_bool IS NOT NULL OR coalesce({_JSON_OK}, FALSE) AS ok FROM "
    f"(SELECT id, value, data_type, CASE WHEN {_LIVE} AND data_type = 'int' AND regexp_full_match(value, '\\s*[+-]?\\d+\\s*') THEN CAST(trim(value) AS BIGINT) END AS v_int, CASE WHEN {_LIVE} AND data_type = 'float' THEN TRY_CAST(value AS DOUBLE) END AS v_double, "
    f"CASE WHEN {_LIVE} AND data_type = 'bool' THEN lower(value) IN ('true', '1', 't', 'y', 'yes') END AS v_bool FROM ({dealt_sql(VALUES, 'value, data_type', *_EVENTS)}))"
)


def ty05_test_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random value, seeded, of a type for each event, and whether it is of that type."""
    kind = F.element_at(F.array(*map(F.lit, ("int", "float", "str", "bool"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("data_type")).withColumn("value", convert.test_value(F.col("data_type")))
    shape = F.when(F.col("data_type") == "int", r"^\d{1,2}$").when(F.col("data_type") == "float", r"^\d{1,2}\.\d{1,2}$|^100\.0$").when(F.col("data_type") == "bool", "^(true|false)$").otherwise("^[0-9A-Za-z]{8}$")
    return rows.select("event_id", "data_type", F.regexp_like("value", shape).alias("ok"))


def ty06_basic_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row as JSON with dates as ISO texts, decimals as numbers, and the JSON text in props parsed."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round(F.col("value").cast("decimal(20,2)").cast("double"), 2).alias("value"))


def ty08_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("checksum"), F.octet_length("text").alias("n_bytes"))


def _file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*(F.lit(x) for x in ("txt", "PNG", "tar.gz", "json", "xyz", "mp4"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.lit("lib/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("."), ext).alias("path"))


FILE_NAMES_SQL = "(SELECT p_partkey, 'lib/' || replace(p_name, ' ', '/') || '.' || ['txt', 'PNG', 'tar.gz', 'json', 'xyz', 'mp4'][p_partkey % 6 + 1] AS path FROM part)"


def ty08_mime_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_names(spark, sf_dir).select("p_partkey", convert.mime_type(F.col("path")).alias("mime"))


def ty09_storage_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(spark, sf_dir)
    return f.select("p_partkey", urls.storage_uri(F.lit("s3"), F.lit("bucket"), F.col("p_partkey").cast("string"), F.col("path")).alias("uri"), urls.version_uri(F.lit("s3"), F.lit("bucket"), F.lit("versions"), F.col("p_partkey").cast("string"), F.lit("3"), paths.basename(F.col("path"))).alias("version_uri"))


def ty10_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(spark, sf_dir)
    return f.select(F.explode(paths.ancestors(F.col("path"))).alias("folder"), paths.basename(F.col("path")).alias("name"), paths.dirname(F.col("path")).alias("dir")).groupBy("folder").agg(F.count("*").alias("n"), F.countDistinct("dir").alias("n_dirs"), F.min("name").alias("first_name"))


def ty11_higher_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of line items by flag and by status; how often each pair occurs, and the higher one."""
    level = lambda c: F.when(F.col(c) == "N", "admin").when(F.col(c) == "A", "write").when(F.col(c).isin("R", "O"), "read").otherwise("none")
    pairs = table(spark, sf_dir, "lineitem").select(level("l_returnflag").alias("a"), level("l_linestatus").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", "n", access.rank(F.col("a")).alias("rank_a"), access.higher(F.col("a"), F.col("b")).alias("out"))


def ty12_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = F.base64(F.encode("p_name", "utf-8"))
    return p.select("p_partkey", b.alias("encoded"), F.decode(F.unbase64(b), "utf-8").alias("decoded"))


ADDRESSES = [(x,) for x in (
    "s3://bucket/{t}/b{n}.txt", "S3://Bucket//{t}", "server://files{n}", "supabase://pics/{n}.png", "https://abc123.supabase.co/storage/v1/object/public/pics/{t}/{n}.png", "https://abc123.supabase.co/storage/v1/object/sign/{t}/a.png?token=e30.eyJleHAiOjE3MDAwMDAwMDB9.x",
    "https://my-bucket.s3.eu-west-1.amazonaws.com/k/{n}.bin?X-Amz-Date=20240101T000000Z&X-Amz-Expires={n}", "https://s3.amazonaws.com/bkt/{t}/{n}", "https://s3.us-east-1.amazonaws.com/bkt{n}", "https://example.com/{n}", "ftp://x/{t}", "{t}", "", None,
)]
_ADDRESSES = ("events", "event_id", "event_type")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with each event's number and kind in them, and those of the pages."""
    return dealt_df(spark, sf_dir, ADDRESSES, "s", *_ADDRESSES).select("s").unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("s")))


NOW = 1_704_070_000


def ty13_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("s", urls.expires_in(F.col("s"), F.lit(NOW)).alias("seconds"))


def ty14_ensure_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("s", urls.ensure_action(F.col("s"), F.lit(NOW)).alias("out"))


ERRORS = [(x,) for x in ("Connection reset by peer {n}", "404 Not Found: {t}", "503 Service Unavailable", "{t}: Access Denied after timeout", "SlowDown {n}", "disk full at {t}", None, "{t}")]


def ty15_transient_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_df(spark, sf_dir, ERRORS, "s", *_ADDRESSES).select("id", "s", urls.is_transient(F.col("s")).alias("out"))


def ty17_storage_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = urls.parse_storage_url(F.col("s"))
    return _addresses(spark, sf_dir).select("s", p["scheme"].alias("scheme"), p["storage_path"].alias("storage_path"), urls.native_uri(F.col("s")).alias("uri"), urls.is_cloud_uri(F.col("s")).alias("is_cloud"), urls.is_storage_url(F.col("s")).alias("is_storage"))


def ty19_cover_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = convert.cover_crop(F.col("p_size") * 37 + 11, F.col("p_size") * 11 + 29, 640, 480)
    return p.select("p_partkey", c["w"].alias("w"), c["h"].alias("h"), c["left"].alias("crop_left"), c["top"].alias("crop_top"))


def ty21_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", convert.frame_index(F.col("p_size") * 30, (F.col("p_partkey") % 11) / F.lit(10.0) - 0.2).alias("frame"))


SETTINGS = [("true",), ("False",), ("1",), ("",), (None,), ("TRUE",), ("{t}",), ("true{n}",)]


def ty22_env_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_df(spark, sf_dir, SETTINGS, "s", *_ADDRESSES).select("id", "s", convert.env_bool(F.col("s")).alias("out"))


LITERALS = [(None, "text"), ("none", "text"), ("x{n}", "USER-DEFINED"), ("True", "boolean"), ("", "text"), ("gen_random_uuid()", "uuid"), ("[]", "text"), ("a,{n}", "ARRAY"), ("{bad{n}", "json"), ("{n}", "bigint"), ("abc{n}", "text"), ("abc", None), ("{n}.5", "real")]


def st21_store_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_df(spark, sf_dir, LITERALS, "value, data_type", *_EVENTS).select("id", "value", "data_type", convert.store_literal(F.col("value"), F.col("data_type")).alias("out"))


QUERIES |= {f.__name__: f for f in (ty04_convert_value, ty05_test_values, ty06_basic_json, ty08_digest, ty08_mime_type, ty09_storage_uri, ty10_ancestors, ty11_higher_level, ty12_base64, ty13_expiry, ty14_ensure_action, ty15_transient_error, ty17_storage_url, ty19_cover_crop, ty21_frame_index, ty22_env_bool, st21_store_literal)}
_MIME = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in convert.MIME.items()) + "}"
_RANK = "CASE {0} WHEN 'admin' THEN 3 WHEN 'write' THEN 2 WHEN 'read' THEN 1 ELSE 0 END"
_ADDR = f"(SELECT s FROM ({dealt_sql(ADDRESSES, 's', *_ADDRESSES)}) UNION ALL SELECT url FROM pages)"
_JWT = "TRY_CAST(json_extract_string(CASE WHEN contains(s, 'token=') THEN decode(from_base64(split_part(regexp_extract(s, 'token=([^&]*)', 1), '.', 2) || repeat('=', (4 - length(split_part(regexp_extract(s, 'token=([^&]*)', 1), '.', 2)) % 4) % 4))) END, '$.exp') AS BIGINT)"
_AMZ = "CASE WHEN contains(s, 'X-Amz-Date=') THEN CAST(epoch(strptime(regexp_extract(s, 'X-Amz-Date=([^&]*)', 1), '%Y%m%dT%H%M%SZ')) AS BIGINT) + CAST(regexp_extract(s, 'X-Amz-Expires=([^&]*)', 1) AS BIGINT) END"
_LEFT = f"(coalesce({_JWT}, {_AMZ}) - {NOW})"
_CLOUD = "coalesce(regexp_matches(s, '(?i)^(s3|supabase|server)://'), FALSE)"
_PATH = (
    "CASE WHEN regexp_matches(s, '(?i)^https?://[a-z0-9]+\\.supabase\\.co/storage/v1/object/(public|sign|authenticated)/[^/?#]+/[^?#]+') THEN regexp_extract(s, '/object/(?:public|sign|authenticated)/([^?#]+)', 1) "
    "WHEN regexp_matches(s, '(?i)^https?://[a-z0-9.-]+\\.s3(\\.[a-z0-9-]+)?\\.amazonaws\\.com/[^?#]+') THEN regexp_extract(s, '(?i)^https?://([a-z0-9.-]+)\\.s3(?:\\.[a-z0-9-]+)?\\.amazonaws\\.com/', 1) || '/' || regexp_extract(s, 'amazonaws\\.com/([^?#]+)', 1) "
    "WHEN regexp_matches(s, '(?i)^https?://s3(\\.[a-z0-9-]+)?\\.amazonaws\\.com/[^/?#]+/[^?#]+') THEN regexp_extract(s, 'amazonaws\\.com/([^?#]+)', 1) "
    f"WHEN {_CLOUD} THEN rtrim(regexp_replace(regexp_extract(s, '://(.*)$', 1), '//+', '/', 'g'), '/') END"
)
_SCHEME = f"CASE WHEN {_CLOUD} THEN lower(split_part(s, '://', 1)) WHEN ({_PATH}) IS NOT NULL AND contains(s, 'supabase.co/') THEN 'supabase' WHEN ({_PATH}) IS NOT NULL THEN 's3' END"
_W, _H = "(p_size * 37 + 11)", "(p_size * 11 + 29)"
_WIDE = f"(CAST({_W} AS DOUBLE) / {_H} > 640.0 / 480.0)"
_NW = f"CAST(CASE WHEN {_WIDE} THEN floor(480 * CAST({_W} AS DOUBLE) / {_H}) ELSE 640 END AS INTEGER)"
_NH = f"CAST(CASE WHEN {_WIDE} THEN 480 ELSE floor(640 * CAST({_H} AS DOUBLE) / {_W}) END AS INTEGER)"
ORACLE_SQL |= {
    "ty05_test_values": "SELECT event_id, ['int', 'float', 'str', 'bool'][event_id % 4 + 1] AS data_type, TRUE AS ok FROM events",
    "ty06_basic_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day, round(CAST(CAST(value AS DECIMAL(20, 2)) AS DOUBLE), 2) AS value FROM events",
    "ty08_digest": "SELECT doc_id, sha256(text) AS checksum, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes FROM documents",
    "ty08_mime_type": f"SELECT p_partkey, coalesce({_MIME}[lower(regexp_extract(path, '\\.([^./]+)$', 1))], 'application/octet-stream') AS mime FROM {FILE_NAMES_SQL}",
    "ty09_storage_uri": f"SELECT p_partkey, 's3://bucket/' || p_partkey || '/' || path AS uri, 's3://bucket/versions/' || p_partkey || '/v3/' || regexp_extract(path, '([^/]*)$', 1) AS version_uri FROM {FILE_NAMES_SQL}",
    "ty10_ancestors": f"SELECT folder, count(*) AS n, count(DISTINCT dir) AS n_dirs, min(name) AS first_name FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/?[^/]*$', '') AS dir FROM {FILE_NAMES_SQL}) GROUP BY folder",
    "ty11_higher_level": f"WITH p AS (SELECT CASE l_returnflag WHEN 'N' THEN 'admin' WHEN 'A' THEN 'write' WHEN 'R' THEN 'read' WHEN 'O' THEN 'read' ELSE 'none' END AS a, CASE l_linestatus WHEN 'N' THEN 'admin' WHEN 'A' THEN 'write' WHEN 'R' THEN 'read' WHEN 'O' THEN 'read' ELSE 'none' END AS b FROM lineitem) SELECT a, b, count(*) AS n, {_RANK.format('a')} AS rank_a, CASE WHEN {_RANK.format('b')} > {_RANK.format('a')} THEN b ELSE a END AS out FROM p GROUP BY a, b",
    "ty12_base64": "SELECT p_partkey, to_base64(encode(p_name)) AS encoded, p_name AS decoded FROM part",
    "ty13_expiry": f"SELECT s, {_LEFT} AS seconds FROM {_ADDR}",
    "ty14_ensure_action": f"SELECT s, CASE WHEN {_CLOUD} THEN 'sign' WHEN {_LEFT} IS NULL OR {_LEFT} > 60 THEN 'keep' ELSE 'resign' END AS out FROM {_ADDR}",
    "ty15_transient_error": f"SELECT id, s, CASE WHEN regexp_matches(lower(s), '{'|'.join(urls.PERMANENT)}') THEN FALSE WHEN regexp_matches(lower(s), '{'|'.join(urls.TRANSIENT)}') THEN TRUE ELSE FALSE END AS out FROM ({dealt_sql(ERRORS, 's', *_ADDRESSES)})",
    "ty17_storage_url": f"SELECT s, {_SCHEME} AS scheme, {_PATH} AS storage_path, ({_SCHEME}) || '://' || ({_PATH}) AS uri, {_CLOUD} AS is_cloud, ({_PATH}) IS NOT NULL AS is_storage FROM {_ADDR}",
    "ty19_cover_crop": f"SELECT p_partkey, {_NW} AS w, {_NH} AS h, CAST(floor(({_NW} - 640) / 2) AS INTEGER) AS crop_left, CAST(floor(({_NH} - 480) / 2) AS INTEGER) AS crop_top FROM part",
    "ty21_frame_index": "SELECT p_partkey, greatest(0, CAST(trunc(p_size * 30 * ((p_partkey % 11) / CAST(10.0 AS DOUBLE) - CAST(0.2 AS DOUBLE))) AS INTEGER)) AS frame FROM part",
    "ty22_env_bool": f"SELECT id, s, CASE lower(s) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS out FROM ({dealt_sql(SETTINGS, 's', *_ADDRESSES)})",
    "st21_store_literal": f"SELECT id, value, data_type, CASE WHEN value IS NULL OR lower(value) = 'none' THEN 'null' WHEN data_type = 'USER-DEFINED' THEN '''' || value || '''' WHEN data_type = 'boolean' THEN lower(value) WHEN value = '' THEN '''''' WHEN value = 'gen_random_uuid()' THEN 'uuidv4()' WHEN value = '[]' OR data_type = 'ARRAY' THEN value WHEN data_type IN ('bigint', 'smallint', 'integer', 'real') THEN value ELSE '''' || value || '''' END AS out FROM ({dealt_sql(LITERALS, 'value, data_type', *_EVENTS)})",
}
