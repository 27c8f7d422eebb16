"""Queries of record shaping and JSON documents over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert
from ..operators import records
from ..operators.records import Field
from ..sources import files
from .common import table
from .types import FILE_NAMES_SQL, _file_names

FIELDS = [Field("event_kind", always=True), Field("user", "int"), Field("score", "float", default=1.5, always=True), Field("flag", "bool", default=True), Field("missing", always=True, default="none"), Field("absent")]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    score = F.when(u % 3 == 0, F.lit("default")).otherwise(F.concat(u.cast("string"), F.lit(".5")))
    m = F.create_map(F.lit("eventKind"), "event_type", F.lit("uid"), F.when(u % 4 == 0, F.lit("x")).otherwise(u.cast("string")), F.lit("score"), score, F.lit("flag"), F.when(u % 5 == 0, F.lit("")).otherwise("false"))
    return e.select("event_id", m.alias("values"))


def pj01_shape_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = records.shape(_values(spark, sf_dir), "values", FIELDS, {"uid": "user"}, camel=True)
    return shaped.withColumn("present", F.array_join(F.array_sort("present"), ","))


def pj02_shape_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a struct: its fields are the keys."""
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event_kind"), F.col("event_type")).alias("values"))
    return records.shape(e, "values", FIELDS).select("event_id", "event_kind", "user", "score", "missing")


def pj03_shape_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.shape(_values(spark, sf_dir), "values", FIELDS, {"uid": "user"}, camel=True).groupBy("event_kind", "flag").agg(F.count("*").alias("n"))


def pj04_convert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(records.convert_list(F.array(F.concat(F.lit(" "), F.col("user_id").cast("string")), F.col("event_type"), F.lit("7")), "int"), "|").alias("out"))


def pj06_camel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.keys_to_camel(table(spark, sf_dir, "customer"))


def pj05_rename_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.struct("n_name", F.array(F.struct("n_regionkey")).alias("in")).alias("nation"))
    return records.rename_fields(n, {"n_name": "name", "n_regionkey": "region"}).select("nation.name", F.col("nation.in")[0]["region"].alias("region"))


def pj07_without_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without_terms(_values(spark, sf_dir), "event_id", "values", ("e", "5")).groupBy("found").agg(F.count("*").alias("n"))


def pj08_class_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each nation, its fields named after its customers' market segments, and one of declared fields."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment").distinct()
    n = F.length("c_mktsegment")
    kind = F.when(n % 2 == 0, "int").otherwise("list")
    made = c.select(F.col("n_name").alias("class"), n.alias("pos"), F.lower("c_mktsegment").alias("name"), kind.alias("kind"), F.lit("str").alias("of"), (n > 8).alias("always"), F.when(n % 3 == 0, "7").alias("default"))
    return records.class_text(made.unionByName(spark.createDataFrame(records.field_rows("Event", FIELDS), records.FIELD_ROWS)))


def ty07_not_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of some tables, and of a nested type, isn't JSON's, and how many rows have it."""
    e = table(spark, sf_dir, "events")
    nested = e.select(F.array(F.struct(F.col("ts").alias("at"), F.create_map("user_id", F.encode("event_type", "UTF-8")).alias("m"))).alias("x"))
    found = None
    for df in (e, table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "orders"), nested):
        for path, kind in records.not_basic(df.schema):
            top = F.col(path.split(".")[1].removesuffix("[]"))
            part = df.agg(F.lit(path).alias("path"), F.lit(kind).alias("type"), F.count(top).alias("n_rows"))
            found = part if found is None else found.unionByName(part)
    return found


def st20_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    document = F.concat(F.lit('{"user-id": '), F.col("user_id").cast("string"), F.lit(', "eventKind": "'), "event_type", F.lit('", "in": '), "props", F.lit(', "none": [], "list": [true, null, {"a b": "x\\"y"}]}'))
    return e.select("event_id", convert.typescript_literal(document).alias("literal"), convert.typescript_const(document, "EVENT", as_const=True, kind="Event").alias("const"))


def pj09_strip_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("user_id").alias("u"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("t"))).alias("out"))


def pj10_files_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.files_json(_file_names(spark, sf_dir))


def sc04_json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.from_json("props", "map<string, string>")
    new = F.create_map(F.when(F.col("user_id") % 2 == 0, "k").otherwise("u"), F.col("user_id").cast("string"))
    m = records.merged_json(old, new)
    return table(spark, sf_dir, "events").select("event_id", m["k"].alias("k"), m["u"].alias("u"))


def sc05_json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.json_entries(table(spark, sf_dir, "events").select("event_id", "props"), "props")


def sc06_serializable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", convert.serializable(F.col("ts")).alias("out"))


QUERIES = {f.__name__: f for f in (pj01_shape_records, pj02_shape_structs, pj03_shape_batch, pj04_convert_list, pj05_rename_keys, pj06_camel_keys, pj07_without_terms, pj08_class_text, pj09_strip_nulls, pj10_files_json, sc04_json_merge, sc05_json_entries, sc06_serializable, st20_typescript, ty07_not_basic)}
_SHAPED = """SELECT event_id, event_type AS event_kind, CASE WHEN user_id % 4 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS user, CASE WHEN user_id % 3 = 0 THEN '1.5' ELSE user_id || '.5' END AS score,
 CASE WHEN user_id % 5 = 0 THEN 'false' ELSE 'true' END AS flag, 'none' AS missing, CAST(NULL AS VARCHAR) AS absent, 'event_kind,flag,missing,score,user' AS present FROM events"""
_CLASSES = r"""WITH f AS (SELECT DISTINCT n_name AS class, length(c_mktsegment) AS pos, lower(c_mktsegment) AS name, CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'int' ELSE 'list' END AS kind, 'str' AS elem, length(c_mktsegment) > 8 AS must, CASE WHEN length(c_mktsegment) % 3 = 0 THEN '7' END AS def FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT * FROM (VALUES ('Event', 0, 'event_kind', 'str', 'str', TRUE, NULL), ('Event', 1, 'user', 'int', 'str', FALSE, NULL), ('Event', 2, 'score', 'float', 'str', TRUE, '1.5'), ('Event', 3, 'flag', 'bool', 'str', FALSE, 'True'), ('Event', 4, 'missing', 'str', 'str', TRUE, chr(39) || 'none' || chr(39)), ('Event', 5, 'absent', 'str', 'str', FALSE, NULL))),
 l AS (SELECT class, pos, NOT (must AND def IS NULL) AS later, '    ' || name || ': ' || CASE kind WHEN 'list' THEN 'list[' || elem || ']' ELSE kind END || CASE WHEN must AND def IS NULL THEN '' ELSE ' | None = ' || CASE WHEN kind = 'list' THEN 'None' ELSE coalesce(def, 'None') END END AS line FROM f)
 SELECT class, 'from dataclasses import asdict, dataclass' || repeat(chr(10), 3) || '@dataclass' || chr(10) || 'class ' || class || ':' || chr(10) || string_agg(line, chr(10) ORDER BY later, pos, line) || chr(10) || chr(10) || '    def to_dict(self):' || chr(10) || '        return {k: v for k, v in asdict(self).items() if v is not None}' || chr(10) AS text FROM l GROUP BY class"""
_BODY = r"""'{' || chr(10) || '    {0}: ' || user_id || ',' || chr(10) || '    eventKind: "' || event_type || '",' || chr(10) || '    in: {' || chr(10) || '        k: ' || json_extract_string(props, '$.k') || chr(10) || '    },' || chr(10) || '    none: [' || chr(10) || '        ' || chr(10) || '    ],' || chr(10)
 || '    list: [' || chr(10) || '        true,' || chr(10) || '        null,' || chr(10) || '        {' || chr(10) || '            {1}: "x"y"' || chr(10) || '        }' || chr(10) || '    ]' || chr(10) || '}'"""
_TYPESCRIPT = "SELECT event_id, " + _BODY.replace("{0}", '"user-id"').replace("{1}", '"a b"') + " AS literal, 'export const EVENT: Event = ' || " + _BODY.replace("{0}", "userId").replace("{1}", "aB") + " || ' as const;' || chr(10) AS const FROM events"
ORACLE_SQL = {
    "pj01_shape_records": _SHAPED,
    "pj02_shape_structs": "SELECT event_id, event_type AS event_kind, CAST(user_id AS VARCHAR) AS user, '1.5' AS score, 'none' AS missing FROM events",
    "pj03_shape_batch": f"SELECT event_kind, flag, count(*) AS n FROM ({_SHAPED}) GROUP BY event_kind, flag",
    "pj04_convert_list": "SELECT event_id, user_id || '|' || event_type || '|7' AS out FROM events",
    "pj05_rename_keys": "SELECT n_name AS name, n_regionkey AS region FROM nation",
    "pj06_camel_keys": "SELECT c_custkey AS \"cCustkey\", c_name AS \"cName\", c_nationkey AS \"cNationkey\", c_acctbal AS \"cAcctbal\", c_mktsegment AS \"cMktsegment\" FROM customer",
    "pj07_without_terms": "WITH v AS (SELECT unnest(['eventKind', event_type, 'uid', CASE WHEN user_id % 4 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END, 'score', CASE WHEN user_id % 3 = 0 THEN 'default' ELSE user_id || '.5' END, 'flag', CASE WHEN user_id % 5 = 0 THEN '' ELSE 'false' END]) AS found FROM events) SELECT found, count(*) AS n FROM v WHERE NOT contains(found, 'e') AND NOT contains(found, '5') GROUP BY found",
    "pj09_strip_nulls": "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}' ELSE '{\"u\":' || user_id || '}' END AS out FROM events",
    "pj08_class_text": _CLASSES,
    "pj10_files_json": f"SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, list_sort(list(regexp_extract(path, '([^/]*)$', 1))) AS files FROM {FILE_NAMES_SQL} GROUP BY 1",
    "sc06_serializable": "SELECT event_id, '{\"value\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '\"}' AS out FROM events",
    "st20_typescript": _TYPESCRIPT,
    "ty07_not_basic": "SELECT 'root.ts' AS path, 'timestamp_ntz' AS type, count(ts) AS n_rows FROM events UNION ALL SELECT 'root.o_orderdate', 'timestamp_ntz', count(o_orderdate) FROM orders UNION ALL SELECT p, t, count(*) FROM events, (VALUES ('root.x[].at', 'timestamp_ntz'), ('root.x[].m.key', 'bigint'), ('root.x[].m{}', 'binary')) v(p, t) GROUP BY p, t",
    "sc04_json_merge": "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN user_id % 2 <> 0 THEN CAST(user_id AS VARCHAR) END AS u FROM events",
    "sc05_json_entries": "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events",
}
