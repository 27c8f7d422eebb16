"""Queries of names, packages and imports over tables derived from parts and line items.

exports: parts, name p_name, path by part key; imports: line items of an order as a file, sources by part; packages:
supplier names; usage: orders and suppliers of line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, paths
from ..operators import code, mentions, reports
from ..sources import files, ordered
from .common import table
from .types import FILE_NAMES_SQL, _file_names

EXPORTS_SQL = "exports AS (SELECT replace(p_name, ' ', '_') || '_' || p_size AS name, 'src/f' || (p_partkey % 97) || '.tsx' AS path, p_partkey % 10 = 0 AS is_default, p_partkey FROM part)"
IMPORTS_SQL = f"imports AS (SELECT 'src/f' || l_orderkey || '.tsx' AS path, 'src/f' || (l_partkey % 150) || '.tsx' AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos FROM lineitem)"
#: Imports of 97 files, each with the items of many orders.
FILE_IMPORTS_SQL = f"imports AS (SELECT 'src/f' || (l_orderkey % 97) || '.tsx' AS path, 'src/f' || (l_partkey % 150) || '.tsx' AS source, row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos FROM lineitem)"
USAGE_SQL = "usage AS (SELECT DISTINCT 'pkg-' || (l_suppkey % 17) AS package, 'f' || (l_orderkey % 1000) AS file, CASE l_linenumber % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'comment' WHEN 2 THEN 'text' ELSE 'import' END AS context, l_linenumber AS line FROM lineitem)"
#: t: path, is_dir, parts, line of files and of the folders above them.
TREE_SQL = """WITH f AS (SELECT DISTINCT path FROM ({0})), d AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM f),
 b AS (SELECT path, FALSE AS is_dir FROM f UNION ALL SELECT path, TRUE FROM d), t AS (SELECT path, is_dir, string_split(path, '/') AS parts, repeat('    ', len(string_split(path, '/')) - 1) || list_last(string_split(path, '/')) || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM b)"""
EXT = "coalesce(nullif(lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^/](\\.[^./]+)$', 1)), ''), '(no ext)')"


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_size").alias("name"), F.concat(F.lit("src/f"), F.col("p_partkey") % 97, F.lit(".tsx")).alias("path"), (F.col("p_partkey") % 10 == 0).alias("is_default"), "p_partkey")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    numbered = items.selectExpr("concat('src/f', l_orderkey, '.tsx') AS path", "concat('src/f', l_partkey % 150, '.tsx') AS source", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos")
    return numbered.withColumn("pos", F.col("pos").cast("long"))


def _file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of 97 files, numbered by prefix sums: items within an order, orders within a block of keys, blocks within a file; so no task
    has a file's items."""
    items = table(spark, sf_dir, "lineitem")
    numbered = items.selectExpr("l_orderkey", "concat('src/f', l_orderkey % 97, '.tsx') AS path", "concat('src/f', l_partkey % 150, '.tsx') AS source", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS n")
    orders = items.groupBy("l_orderkey").agg(F.count("*").alias("n")).selectExpr("l_orderkey", "n", "l_orderkey % 97 AS file", "floor(l_orderkey / 97000D) AS block")
    blocks = orders.groupBy("file", "block").agg(F.sum("n").alias("n")).selectExpr("file", "block", "sum(n) OVER (PARTITION BY file ORDER BY block) - n AS earlier")
    inside = orders.selectExpr("l_orderkey", "file", "block", "sum(n) OVER (PARTITION BY file, block ORDER BY l_orderkey) - n AS before")
    before = inside.join(blocks, ["file", "block"]).selectExpr("l_orderkey", "before + earlier AS before")
    return numbered.join(before, "l_orderkey", "left").select("path", "source", (F.col("n") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    context = F.when(k == 0, "code").when(k == 1, "comment").when(k == 2, "text").otherwise("import")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("pkg-"), F.col("l_suppkey") % 17).alias("package"), F.concat(F.lit("f"), F.col("l_orderkey") % 1000).alias("file"), context.alias("context"), F.col("l_linenumber").alias("line")).distinct()


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(25).select(F.concat(F.lit("pkg-"), F.col("id").cast("string")).alias("package"))


def ag04_extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.extension_histogram(_file_names(spark, sf_dir))


def ag05_excluded_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(spark, sf_dir).where(~paths.allowed_extension(F.col("path"), exclude=(".png", ".xyz", ".gz")))
    return reports.extension_histogram(f).select("ext", "n_files")


def ag18_exclusion_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exclusion_footer(ag05_excluded_extensions(spark, sf_dir))


def ag06_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.collisions(_exports(spark, sf_dir))


def ag07_collision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.collisions(_exports(spark, sf_dir))
    total = c.agg(F.lit("total").alias("what"), F.lit("").alias("name"), F.count("*").alias("n"))
    names = reports.top(c, [F.col("n").desc(), F.col("name")]).select(F.lit("name").alias("what"), "name", "n")
    files = _exports(spark, sf_dir).groupBy("path").count().unionByName(_imports(spark, sf_dir).groupBy("path").count()).groupBy("path").agg(F.sum("count").alias("n"))
    busiest = reports.top(files, [F.col("n").desc(), F.col("path")]).select(F.lit("file").alias("what"), F.col("path").alias("name"), "n")
    return total.unionByName(names).unionByName(busiest)


def so05_top_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(reports.collisions(_exports(spark, sf_dir)), [F.col("n").desc(), F.col("name")]).select("name", "n")


def jn08_collision_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exports(spark, sf_dir)
    return e.join(reports.collisions(e).select("name"), "name", "left_semi").select("p_partkey", "name", "path")


def ag08_package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.package_counts(_usage(spark, sf_dir), _packages(spark, sf_dir))


def set01_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.package_counts(_usage(spark, sf_dir), _packages(spark, sf_dir)).orderBy("file_count", "package")


def jn06_import_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _packages(spark, sf_dir).select(F.upper("package").alias("import_name"), "package")
    names = names.unionByName(names.where("package in ('pkg-1', 'pkg-2')").withColumn("package", F.lit("pkg-both")))
    return reports.resolve_packages(_usage(spark, sf_dir).withColumnRenamed("package", "import_name"), names).groupBy("package").agg(F.count("*").alias("n"))


def jn13_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports.package_counts(_usage(spark, sf_dir), _packages(spark, sf_dir))
    companions = spark.createDataFrame([("pkg-1", "pkg-20"), ("pkg-22", "pkg-23")], "primary string, companion string")
    return reports.without_companions(counts.where("file_count = 0").select("package"), counts.where("file_count > 0").select("package"), companions)


def ag10_dominant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dominant_context(_usage(spark, sf_dir))


def ag11_action_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.action_tiers(reports.dominant_context(_usage(spark, sf_dir)))


def ag09_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import versions

    return versions.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def ag12_size_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    return d.select("source", "n_bytes", convert.megabytes(F.col("n_bytes") * 7).alias("mb"))


def so04_top_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    return reports.top(d, [F.col("n_bytes").desc(), F.col("source")], 5)


def ag13_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _imports(spark, sf_dir)
    return reports.dependency_sets(i.select(F.col("path").alias("module"), F.col("source").alias("name"), F.substring("source", 6, 1).isin("1", "2", "3").alias("is_internal")))


def ag14_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamps = e.select("user_id").distinct().where("user_id % 4 <> 0").select(F.col("user_id").alias("module"), F.lit("2024-01-20 12:00:00").cast("timestamp").alias("stamp"))
    return reports.staleness(e.select(F.col("user_id").alias("module"), F.col("ts").cast("timestamp").alias("modified")), stamps).select("module", F.date_format("newest", "yyyy-MM-dd HH:mm").alias("newest"), "stale")


def ag15_grouped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(spark, sf_dir)
    return reports.grouped_messages(f.select((F.col("p_partkey") % 5 == 0).alias("is_error"), F.concat(F.lit("m"), F.col("p_partkey") % 3).alias("message"), "path"))


def ag16_repeated_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.repeated_imports(_file_imports(spark, sf_dir))


def ag17_covered_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.createDataFrame([("lib/small", 0), ("lib/red", 1), ("lib/red/x", 2)], "prefix string, seq int")
    return reports.covered(_file_names(spark, sf_dir), prefixes, "path", "p_partkey")


def jn07_exports_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _exports(spark, sf_dir), _imports(spark, sf_dir)
    c = reports.combined(e.select("path").unionByName(i.select("path")).unionByName(spark.createDataFrame([("src/none.tsx",)], "path string")), e, i)
    return c.select("path", F.size("exports").alias("n_exports"), F.array_join("imports", ",").alias("imports"))


def jn09_invalid_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _imports(spark, sf_dir).withColumn("resolved_path", F.when(F.col("pos") % 5 != 0, F.col("source")))
    return reports.invalid_imports(i, _exports(spark, sf_dir)).select("path", "pos", "source")


def jn10_import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of names that are neither packages known here nor installed."""
    known = _packages(spark, sf_dir).where("package <> 'pkg-3'").unionByName(spark.createDataFrame([("pkg-installed",)], "package string"))
    return _usage(spark, sf_dir).join(known, "package", "left_anti").select("package", "file").distinct()


def jn11_upstream_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usage(spark, sf_dir)
    calls = u.select(F.col("file").alias("path"), F.col("context").alias("callee"), F.concat("file", F.lit("."), "line").alias("caller"))
    imports = u.select(F.col("file").alias("path"), F.col("package").alias("source"))
    return reports.upstream_callers(calls, imports, spark.createDataFrame([("code",), ("import",)], "name string"), "pkg-1")


def jn12_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("src/f1", "app", 0), ("src/f", "lib/../other", 1), ("zzz", "q", 2)], "prefix string, target string, seq int")
    return reports.resolve_alias(_imports(spark, sf_dir).select("path", "pos", "source"), aliases)


def set02_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exports(spark, sf_dir).select("path").intersect(_imports(spark, sf_dir).select(F.col("source").alias("path")))


def set03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).select(F.col("source").alias("path")).distinct().join(_exports(spark, sf_dir).select("path").distinct(), "path", "left_anti")


def set04_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_wins(_exports(spark, sf_dir).select("name", "path", "is_default").distinct())


def ca16_barrel_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written as text by ranges of its order, and its lines read back with their numbers."""
    at = files.scratch_dir(spark, "barrel")
    ordered.write_lines(reports.barrel_lines(_exports(spark, sf_dir).select("name", "path", "is_default").distinct()), "line", reports.BARREL_ORDER, at)
    return ordered.read_lines(spark, at)


def set05_additional_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _exports(spark, sf_dir), _imports(spark, sf_dir)
    return e.select("path").unionByName(i.select(F.col("source").alias("path"))).dropDuplicates(["path"])


def so06_callers_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn11_upstream_callers(spark, sf_dir).select("function", "caller").distinct().orderBy("function", "caller")


def so07_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.tree_rows(_file_names(spark, sf_dir)).orderBy("parts").select("path", "depth", "is_dir", "line")


def _marked_text() -> Column:
    """Texts with names next to `-`, `_` and `.`, and with `# noqa`."""
    return F.replace(F.replace(F.replace("text", F.lit(" in "), F.lit("-in.")), F.lit(" und "), F.lit("_und-")), F.lit(" que "), F.lit(" # noqa que-"))


_MARKED = "replace(replace(replace(text, ' in ', '-in.'), ' und ', '_und-'), ' que ', ' # noqa que-')"


def fl11_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name a word of the first three of a benchmark item, or two of them with `-`: lines of each."""
    words = F.split("text", r"\s+")
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.array(words[0], words[1], words[2], F.concat_ws("-", words[0], words[1]))).alias("package"))
    names = names.unionByName(spark.createDataFrame([("IN",), ("und-die",), ("que-",), (None,), ("",)], "package string"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), _marked_text().alias("text"))
    return mentions.mentions(d, names).groupBy("path", "package").agg(F.count("*").alias("n_lines"))


def fl11_vocabulary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents as a name: how many lines have it, in small or capital letters."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), _marked_text().alias("text"))
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("package")).distinct()
    return mentions.line_counts(d, words)


def fl12_checked_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: each line imports its first word; `und` and `the` become marks, every tenth file has one on top."""
    source = F.regexp_replace(F.replace("text", F.lit(" und "), F.lit(" # noqa ")), r"(?m)^", "import ")
    top = F.when(F.col("doc_id") % 10 == 0, "# noqa: import-checker\n").when(F.col("doc_id") % 10 == 1, "\n\n\n\n\n# noqa: import-checker\n").otherwise("")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(top, source).alias("text"))
    return code.checked_imports(d, ("die", "the", "la", "el")).groupBy("path").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("module").alias("last_module"))


QUERIES = {f.__name__: f for f in (
    ag04_extension_histogram, ag05_excluded_extensions, ag06_collisions, ag07_collision_summary, ag08_package_counts, ag09_keep_last, ag10_dominant_context, ag11_action_tiers, ag12_size_totals, ag13_dependencies, ag14_staleness, ag15_grouped_messages,
    ag16_repeated_imports, ag17_covered_prefixes, ag18_exclusion_footer, jn06_import_packages, jn07_exports_imports, jn08_collision_members, jn09_invalid_imports, jn10_import_resolution, jn11_upstream_callers, jn12_alias_resolution, jn13_companions,
    set01_union_counts, set02_intersection, set03_difference, set04_first_wins, set05_additional_files, so04_top_sizes, so05_top_collisions, so06_callers_sorted, so07_tree_order, fl11_mentions, fl11_vocabulary_mentions, fl12_checked_imports, ca16_barrel_index,
)}
_COLLISIONS = f"WITH {EXPORTS_SQL}, c AS (SELECT name, count(*) AS n, list_sort(list(path)) AS paths FROM (SELECT DISTINCT name, path FROM exports) GROUP BY name HAVING count(*) > 1)"
_HIST = f"SELECT {EXT} AS ext, count(*) AS n_files, count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) AS n_dirs FROM {FILE_NAMES_SQL}"
_EXCLUDED = f"SELECT {EXT} AS ext, count(*) AS n_files FROM {FILE_NAMES_SQL} WHERE {EXT} IN ('.png', '.xyz', '.gz') GROUP BY 1"
_COUNTS = f"WITH {USAGE_SQL}, counts AS (SELECT package, count(DISTINCT file) AS file_count FROM usage GROUP BY package UNION ALL SELECT 'pkg-' || i, 0 FROM range(25) r(i) WHERE 'pkg-' || i NOT IN (SELECT package FROM usage))"
_SEV = "CASE context WHEN 'code' THEN 0 WHEN 'import' THEN 0 WHEN 'comment' THEN 2 ELSE 3 END"
_DOMINANT = f"dom AS (SELECT package, file, arg_min(context, CAST({_SEV} AS VARCHAR) || context) AS context, list_sort(list(DISTINCT line)) AS lines FROM usage GROUP BY package, file)"
_CALLERS = "SELECT DISTINCT context AS function, file || '.' || line AS caller, file AS path FROM usage WHERE context IN ('code', 'import') AND file IN (SELECT file FROM usage WHERE starts_with(package, 'pkg-1'))"
_W = "[\\p{L}\\p{N}_]"
ORACLE_SQL = {
    "ag04_extension_histogram": f"{_HIST} GROUP BY 1",
    "ag05_excluded_extensions": _EXCLUDED,
    "ag06_collisions": f"{_COLLISIONS} SELECT * FROM c",
    "ag07_collision_summary": f"{_COLLISIONS}, {IMPORTS_SQL}, f AS (SELECT path, count(*) AS n FROM (SELECT path FROM exports UNION ALL SELECT path FROM imports) GROUP BY path) SELECT 'total' AS what, '' AS name, count(*) AS n FROM c UNION ALL SELECT * FROM (SELECT 'name', name, n FROM c ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'file', path, n FROM f ORDER BY n DESC, path LIMIT 10)",
    "ag08_package_counts": f"{_COUNTS} SELECT * FROM counts",
    "ag09_keep_last": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "ag10_dominant_context": f"WITH {USAGE_SQL}, {_DOMINANT} SELECT * FROM dom",
    "ag11_action_tiers": f"WITH {USAGE_SQL}, {_DOMINANT} SELECT package, count(CASE WHEN context IN ('code', 'import') THEN 1 END) AS code_files, count(CASE WHEN context NOT IN ('code', 'import') THEN 1 END) AS text_files, count(*) AS total FROM dom GROUP BY package",
    "ag12_size_totals": "SELECT source, n_bytes, CASE WHEN n_bytes * 7 / CAST(1048576 AS DOUBLE) >= 1 THEN round_even(n_bytes * 7 / CAST(1048576 AS DOUBLE), 0) ELSE round_even(n_bytes * 7 / CAST(1048576 AS DOUBLE), 1) END AS mb FROM (SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY source)",
    "ag13_dependencies": f"WITH {IMPORTS_SQL}, g AS (SELECT path AS module, coalesce(list_sort(list(DISTINCT source) FILTER (source[6] IN ('1', '2', '3'))), []) AS internal, coalesce(list_sort(list(DISTINCT source) FILTER (source[6] NOT IN ('1', '2', '3'))), []) AS external FROM imports GROUP BY path) SELECT module, internal, CASE WHEN len(external) <= 15 THEN external END AS external, CAST(len(external) AS INTEGER) AS n_external FROM g",
    "ag14_staleness": "SELECT user_id AS module, strftime(date_trunc('minute', max(ts)), '%Y-%m-%d %H:%M') AS newest, user_id % 4 = 0 OR date_trunc('minute', max(ts)) > TIMESTAMP '2024-01-20 12:00:00' AS stale FROM events GROUP BY user_id",
    "ag15_grouped_messages": f"SELECT p_partkey % 5 = 0 AS is_error, 'm' || (p_partkey % 3) AS message, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext, list_sort(list(DISTINCT path)) AS paths FROM {FILE_NAMES_SQL} GROUP BY 1, 2, 3",
    "ag16_repeated_imports": f"WITH {FILE_IMPORTS_SQL} SELECT path, source, pos FROM imports QUALIFY row_number() OVER (PARTITION BY path, source ORDER BY pos) > 1",
    "ag17_covered_prefixes": f"WITH x AS (SELECT *, CASE WHEN starts_with(path, 'lib/small/') THEN 'lib/small' WHEN starts_with(path, 'lib/red/') THEN 'lib/red' END AS pre FROM {FILE_NAMES_SQL}) SELECT pre AS prefix, count(*) AS n, arg_min(path, p_partkey) AS first, arg_max(path, p_partkey) AS last FROM x WHERE pre IS NOT NULL GROUP BY pre UNION ALL SELECT path, 1, path, path FROM x WHERE pre IS NULL",
    "ag18_exclusion_footer": f"SELECT string_agg(n_files || ' ' || ext, ', ' ORDER BY n_files DESC, ext) AS footer FROM ({_EXCLUDED})",
    "jn06_import_packages": f"WITH {USAGE_SQL}, n AS (SELECT 'pkg-' || i AS k, 'pkg-' || i AS package FROM range(25) r(i) UNION ALL SELECT * FROM (VALUES ('pkg-1', 'pkg-both'), ('pkg-2', 'pkg-both'))) SELECT n.package, count(DISTINCT file) AS n FROM usage JOIN n ON n.k = usage.package GROUP BY n.package",
    "jn07_exports_imports": f"WITH {EXPORTS_SQL}, {IMPORTS_SQL}, p AS (SELECT path FROM exports UNION SELECT path FROM imports UNION SELECT 'src/none.tsx') SELECT p.path, CAST(coalesce((SELECT count(DISTINCT name) FROM exports e WHERE e.path = p.path), 0) AS INTEGER) AS n_exports, coalesce((SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM imports i WHERE i.path = p.path), '') AS imports FROM p",
    "jn08_collision_members": f"{_COLLISIONS} SELECT p_partkey, name, path FROM exports WHERE name IN (SELECT name FROM c)",
    "jn09_invalid_imports": f"WITH {EXPORTS_SQL}, {IMPORTS_SQL} SELECT path, pos, source FROM imports WHERE pos % 5 <> 0 AND source NOT IN (SELECT path FROM exports)",
    "jn10_import_resolution": f"WITH {USAGE_SQL} SELECT DISTINCT package, file FROM usage WHERE package = 'pkg-3'",
    "jn11_upstream_callers": f"WITH {USAGE_SQL} {_CALLERS}",
    "jn12_alias_resolution": f"WITH {IMPORTS_SQL} SELECT path, pos, source, CASE WHEN starts_with(source, 'src/f1') THEN 'app/' || substr(source, 7) ELSE 'other/' || substr(source, 6) END AS resolved_path FROM imports",
    "jn13_companions": f"{_COUNTS} SELECT package FROM counts WHERE file_count = 0 AND package <> 'pkg-20'",
    "set01_union_counts": f"{_COUNTS} SELECT * FROM counts ORDER BY file_count, package",
    "set02_intersection": f"WITH {EXPORTS_SQL}, {IMPORTS_SQL} SELECT path FROM exports INTERSECT SELECT source FROM imports",
    "set03_difference": f"WITH {EXPORTS_SQL}, {IMPORTS_SQL} SELECT source AS path FROM imports EXCEPT SELECT path FROM exports",
    "set04_first_wins": f"WITH {EXPORTS_SQL} SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_default DESC, path) = 1 AS chosen FROM (SELECT DISTINCT name, path, is_default FROM exports)",
    "set05_additional_files": f"WITH {EXPORTS_SQL}, {IMPORTS_SQL} SELECT path FROM exports UNION SELECT source FROM imports",
    "so04_top_sizes": "SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY source ORDER BY n_bytes DESC, source LIMIT 5",
    "so05_top_collisions": f"{_COLLISIONS} SELECT name, n FROM c ORDER BY n DESC, name LIMIT 10",
    "so06_callers_sorted": f"WITH {USAGE_SQL} SELECT DISTINCT function, caller FROM ({_CALLERS}) ORDER BY function, caller",
    "so07_tree_order": f"{TREE_SQL.format(f'SELECT path FROM {FILE_NAMES_SQL}')} SELECT path, CAST(len(parts) - 1 AS INTEGER) AS depth, is_dir, line FROM t",
    "ca16_barrel_index": f"""WITH {EXPORTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_default DESC, path) = 1 AS chosen FROM (SELECT DISTINCT name, path, is_default FROM exports))
 SELECT row_number() OVER (ORDER BY NOT is_default, path, name) AS ordinal, CASE WHEN chosen THEN '' ELSE '// ' END || CASE WHEN is_default THEN 'export {{ default as ' ELSE 'export {{ ' END || name || ' }} from ' || chr(39) || './' || regexp_replace(path, '[.][a-zA-Z0-9]+$', '') || chr(39) || ';' AS line FROM r""",
    # the name stands, and a border is where just one of the signs on its sides is a word's.
    "fl11_mentions": f"""WITH l AS (SELECT doc_id, row_number() OVER () AS id, lower(line) AS line FROM (SELECT doc_id, unnest(string_split({_MARKED}, chr(10))) AS line FROM documents)),
 w AS (SELECT string_split_regex(text, '\\s+') AS w FROM benchmark), n AS (SELECT DISTINCT p FROM (SELECT unnest([w[1], w[2], w[3], w[1] || '-' || w[2], 'IN', 'und-die', 'que-']) AS p FROM w) WHERE p <> ''),
 f AS (SELECT DISTINCT p, lower(unnest([p, replace(p, '-', '_')])) AS form FROM n), c AS (SELECT doc_id, id, p, form, string_split(line, form) AS parts FROM l, f WHERE contains(line, form)),
 o AS (SELECT doc_id, id, p, form, parts[i] AS before, parts[i + 1] AS after, i, len(parts) AS n FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM c)),
 b AS (SELECT doc_id, id, p, form[1] AS first, form[-1] AS last, CASE WHEN before <> '' THEN before[-1] WHEN i > 1 THEN form[-1] ELSE ' ' END AS before, CASE WHEN after <> '' THEN after[1] WHEN i < n - 1 THEN form[1] ELSE ' ' END AS after FROM o)
 SELECT CAST(doc_id AS VARCHAR) AS path, p AS package, count(DISTINCT id) AS n_lines FROM b WHERE regexp_matches(before, '{_W}') <> regexp_matches(first, '{_W}') AND regexp_matches(after, '{_W}') <> regexp_matches(last, '{_W}') GROUP BY 1, 2""",
    "fl11_vocabulary_mentions": f"""WITH l AS (SELECT row_number() OVER () AS id, line FROM (SELECT unnest(string_split({_MARKED}, chr(10))) AS line FROM documents)),
 w AS (SELECT DISTINCT id, word FROM (SELECT id, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM l)), s AS (SELECT DISTINCT id, lower(word) AS low FROM w), n AS (SELECT DISTINCT word FROM w)
 SELECT n.word AS package, count(*) AS n_lines FROM n JOIN s ON lower(n.word) = s.low GROUP BY n.word""",
    "fl12_checked_imports": r"""WITH f AS (SELECT doc_id, string_split(CASE doc_id % 10 WHEN 0 THEN '# noqa: import-checker' || chr(10) WHEN 1 THEN repeat(chr(10), 5) || '# noqa: import-checker' || chr(10) ELSE '' END || regexp_replace(replace(text, ' und ', ' # noqa '), '(?m)^', 'import ', 'g'), chr(10)) AS lines FROM documents WHERE doc_id % 10 <> 0),
 l AS (SELECT doc_id, lines[i] AS s, i AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM f)),
 m AS (SELECT doc_id, line, regexp_extract(s, '^\s*import\s+(\w[\w.]*)', 1) AS module FROM l WHERE NOT contains(s, '# noqa'))
 SELECT CAST(doc_id AS VARCHAR) AS path, count(*) AS n, CAST(min(line) AS INTEGER) AS first_line, max(module) AS last_module FROM m WHERE module <> '' AND string_split(module, '.')[1] NOT IN ('die', 'the', 'la', 'el') GROUP BY doc_id""",
}
