"""Queries of source code over files derived from parts, of files and folders, and streams of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer, paths
from ..operators import callers, code, mentions, reports
from ..sources import files, ordered
from ..streaming import versions as stream
from . import corpus
from .common import table
from .corpus import sources as _files
from .reports import TREE_SQL

F_SQL = corpus.FILES_SQL


def ca04_strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", code.strip_comments(F.col("text")).alias("out"))


def ca04_strip_document_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(code.strip_comments(F.col("text"))).alias("digest"))


def ca04_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files of four languages: every line as a string with comment marks in it, then as a comment."""
    lang = F.element_at(F.array(F.lit("rust"), F.lit("python"), F.lit("typescript"), F.lit("lua")), (F.col("doc_id") % 4 + 1).cast("int"))
    shape = F.when(lang == "rust", 'x = r#"/* %s " // "#; /* a /* %s */ " */ y = \'"\'; // %s').when(lang == "python", "x = '''# %s\n//''' # %s \"\ny = \"#\\\"#\" + '%s'")
    shape = shape.when(lang == "typescript", "x = `// %s\n/*` /* %s\n' */ + '//' + \"%s /*\" // z").otherwise("x = [=[--[[ %s]] ]=] --[[ %s\n ]] y = '--' .. \"%s\" -- z")
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.replace(shape, F.lit("%s"), F.regexp_replace(line, r"[^\p{L}\p{N} ]", "")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(lexer.without_comments(F.array_join(lines, "\n"), lang)).alias("digest"))


def ca03_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' tree written as text by ranges of its order, and its lines read back with their numbers."""
    at = files.scratch_dir(spark, "tree-text")
    ordered.write_lines(code.tree_rows(_files(spark, sf_dir)), "line", ["parts"], at)
    return ordered.read_lines(spark, at)


def _customer_tree(spark: SparkSession, sf_dir: str) -> str:
    """Customers' names as text files in folders by region, nation and segment; some segments have a folder more."""
    at = files.scratch_dir(spark, "customers")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_name", F.concat(F.lit("region_"), "n_regionkey").alias("r"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("n"), F.concat(F.lit("to_"), F.lower("c_mktsegment")).alias("segment"))
    rows.repartition("r", "n").write.partitionBy("r", "n", "segment").text(at)
    return at


_RULES = {"exact": ("r=region_1", "segment=to_building", "N=NATION_5"), "words": ("machinery",), "include": (".txt",)}


def ca02_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with files below a target folder, for each region as the target; one that is missing has none."""
    at = _customer_tree(spark, sf_dir)
    found = None
    for r in (0, 2, 3, 99):
        part = files.walk(spark, f"{at}/r=region_{r}", **_RULES).where("not is_dir").select(F.lit(r).alias("target"), paths.dirname(F.col("path")).alias("dir")).distinct()
        found = part if found is None else found.unionByName(part)
    return found


def sc18_pruned_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders that the walk entered, and those with files: nothing below an excluded folder is among them."""
    found = files.walk(spark, _customer_tree(spark, sf_dir), **_RULES)
    entered = found.where("is_dir").select(F.lit("entered").alias("what"), F.col("path").alias("dir"))
    return entered.unionByName(found.where("not is_dir").select(F.lit("files").alias("what"), paths.dirname(F.col("path")).alias("dir")).distinct())


def ca05_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in Latin-1 and in UTF-8 by turns."""
    text = F.concat(F.col("path"), F.lit("é"))
    raw = _files(spark, sf_dir).select("path", F.when(F.length("path") % 2 == 0, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("bytes"))
    return raw.select("path", code.decoded(F.col("bytes")).alias("out"))


def ca06_python_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.python_signatures(_files(spark, sf_dir))


def ca07_regex_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.regex_signatures(_files(spark, sf_dir))


def ca08_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.calls(_files(spark, sf_dir), ignore=("sum",))


def ca09_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.definitions(_files(spark, sf_dir))


def ca10_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = [code.context(_files(spark, sf_dir), m).withColumn("mode", F.lit(m)) for m in ("original", "clean", "signatures", "tree")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).unionByName(modes[3])


def ca13_react_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.react_exports(_files(spark, sf_dir).where("path like '%.tsx'"), ignore=("helper",))


def ca14_react_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.react_imports(_files(spark, sf_dir).where("path like '%.tsx'"))


def ca15_react_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where("path like '%.tsx'")
    e = code.react_exports(f, ignore=("helper",)).select("path", F.explode("named_exports").alias("name"))
    return reports.combined(f, e, code.react_imports(f))


def ca17_python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.python_imports(_files(spark, sf_dir)).where("error is null").select("path", "import_name", "line")


def ca19_mention_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where("path like '%.py'")
    return code.mention_context(f, mentions.mentions(f, spark.createDataFrame([("numpy",), ("json",)], "package string")))


def ca08_callers_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls make_24 of part 24's file, at any depth and through renamed imports of other files."""
    f = _files(spark, sf_dir).where("path like '%.py'")
    edges = callers.resolved(code.calls(f, ignore=("sum",)).where("error is null"), code.python_symbols(f).where("error is null"))
    return callers.reaching(edges, spark.createDataFrame([("lib.m24.make_24",)], "function string")).select("caller", "depth")


def jn11_transitive_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions that call the part of their supplier's number in each line item: who reaches functions 1, 2 and 3."""
    items = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("f"), F.col(c))
    edges = items.where("l_partkey % 10 = l_linenumber").select(name("l_partkey").alias("caller"), name("l_suppkey").alias("callee"))
    return callers.reaching(edges, spark.createDataFrame([("f1",), ("f2",), ("f3",)], "function string")).select("function", "caller")


def sc01_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names written as text files and read back whole; a folder that is missing gives nothing."""
    at = files.scratch_dir(spark, "text")
    files.write_text(table(spark, sf_dir, "nation").select("n_name"), at)
    whole = files.read_text(spark, at).unionByName(files.read_text(spark, f"{at}-missing"))
    return whole.select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''")


def sc02_resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.expr("repeat('/..', p_size % 4)")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "../").otherwise("./"), "p_brand", F.lit("/.."), up, F.lit("//"), "p_name").alias("path"))
    return p.select("p_partkey", paths.resolved(F.lit("/srv/app/"), F.col("path")).alias("out"))


def sc03_append_list_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after writing and appending, and whether files are there before and after they are deleted."""
    at, other = files.scratch_dir(spark, "lines"), files.scratch_dir(spark, "gone")
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    files.write_text(names, at)
    files.write_text(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), at, append=True)
    files.write_text(names, other)
    there = [files.exists(spark, other), files.delete(spark, other), files.exists(spark, other), files.delete(spark, other)]
    listed = files.tree(spark, at, "part-*").where("n_bytes > 0").agg(F.lit("files").alias("what"), (F.count("*") > 1).cast("string").alias("value"))
    lines = files.read_texts(spark, at).select(F.lit("line").alias("what"), F.col("text").alias("value"))
    return lines.unionByName(listed).unionByName(spark.createDataFrame([("deleted", str(there))], "what string, value string"))


def sc07_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages and documents through text files: a sign that none of them has ends each."""
    at = files.scratch_dir(spark, "documents")
    files.write_text(table(spark, sf_dir, "documents").select("text"), at, end="\x1e")
    files.write_text(table(spark, sf_dir, "pages").select("html"), at, append=True, end="\x1e")
    return files.read_texts(spark, at, end="\x1e").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


def sc10_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck for each region with a slide for each nation, made, and read as slides."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    decks = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))

    def make(batches):
        for b in batches:
            content = [files.deck([[r["n_name"], f"of {name}"] if r["n_nationkey"] % 5 else [] for r in x]) for name, x in zip(b["r_name"], b["x"], strict=True)]
            yield pd.DataFrame({"path": b["r_name"] + ".pptx", "content": content})

    return files.slides(decks.mapInPandas(make, "path string, content binary"))


def sc17_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = files.scratch_dir(spark, "report")
    report = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.lit('a "b", c').alias("note"))
    files.write_report(report, f"{at}/csv")
    files.write_report(report, f"{at}/json", "json")
    back = spark.read.option("header", True).csv(f"{at}/csv").withColumn("kind", F.lit("csv"))
    back = back.unionByName(spark.read.json(f"{at}/json").withColumn("kind", F.lit("json")).withColumn("n", F.col("n").cast("string")))
    return back.select("kind", "c_mktsegment", F.col("n").cast("long").alias("n"), "note")


def sc18_file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with files under a root, but for excluded ones."""
    at = files.scratch_dir(spark, "tree")
    n = table(spark, sf_dir, "nation")
    n.select("n_name", F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("r"), (F.col("n_nationkey") % 3).alias("k")).write.partitionBy("r", "k").text(at)
    found = files.tree(spark, at, "*.txt", exact=("k=1",), include=(".txt",))
    return found.select(paths.dirname(F.col("path")).alias("dir")).distinct()


def sc20_generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = paths.generated_name(F.when(F.col("user_id") % 2 == 0, "logs"), F.col("event_type"), F.col("event_id").cast("string"), "json", F.col("ts"))
    return e.select("event_id", name.alias("out"))


def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming counts; tests run the stream itself."""
    return stream.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type"), "6 hours")


QUERIES = {f.__name__: f for f in (ca02_discover, sc18_pruned_walk, ca03_tree_text, ca04_strip_comments, ca04_strip_document_comments, ca04_by_language, ca05_decoded, ca06_python_signatures, ca07_regex_signatures, ca08_call_graph, ca09_definitions, ca10_context, ca13_react_exports, ca14_react_imports, ca15_react_pipeline, ca17_python_imports, ca19_mention_context, ca08_callers_over_files, jn11_transitive_callers, sc01_text_files, sc02_resolved_paths, sc03_append_list_delete, sc07_document_files, sc10_slides, sc17_reports, sc18_file_tree, sc20_generated_names, stream_windowed_counts)}
_BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '''''''[\s\S]*?''''''', '', 'g'), '\"\"\"[\s\S]*?\"\"\"', '', 'g'), '#[^\n]*', '', 'g'), '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '--\[\[[\s\S]*?\]\]', '', 'g'), '--[^\n]*', '', 'g'), '<!--[\s\S]*?-->', '', 'g')"
_STRIP = "regexp_replace(" + _BARE.replace('\\"', '"') + r", '\n[ \t]*\n[ \t]*\n+', chr(10) || chr(10), 'g')"
_NO_COMMENTS = r"regexp_replace(regexp_replace(text, '//.*', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"
_IMPORT = r"""import\s+(?:([a-zA-Z0-9_$]+)\s*,\s*)?(?:\{{([^\}}]+)\}})?\s+from\s+[''"]([^''"]+)[''"];?""".replace("{{", "{").replace("}}", "}")
_TRIMMED = r"lambda n: trim(n, ' ' || chr(10) || chr(9))"
_EXPORTS = (
    f"WITH t AS (SELECT path, {_NO_COMMENTS} AS s FROM {F_SQL} WHERE path LIKE '%.tsx'), d AS (SELECT path, s, regexp_extract(s, 'export\\s+default\\s+(?:async\\s+)?(?:function\\s+)?(?:[a-zA-Z_][a-zA-Z0-9_]*\\(|)([a-zA-Z_][a-zA-Z0-9_]*)', 1) AS d FROM t) "
    f"SELECT path, nullif(d, '') AS default_export, list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(s, 'export\\s+(?:const|function|type|interface)\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1), list_transform(flatten(list_transform(regexp_extract_all(s, 'export\\s+\\{{\\s*([^}}]*)\\s*\\}}', 1), lambda x: string_split(x, ','))), {_TRIMMED}))), lambda n: n NOT IN ('', d, 'helper'))) AS named_exports FROM d"
)
_IMPORTS = (
    f"WITH t AS (SELECT path, regexp_extract_all({_NO_COMMENTS}, '{_IMPORT}') AS m FROM {F_SQL} WHERE path LIKE '%.tsx'), r AS (SELECT path, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(m[i], '{_IMPORT}', 1) AS d, regexp_extract(m[i], '{_IMPORT}', 2) AS n, regexp_extract(m[i], '{_IMPORT}', 3) AS source FROM (SELECT path, m, unnest(range(1, len(m) + 1)) AS i FROM t)) "
    f"SELECT path, pos, CASE WHEN starts_with(source, '@/') THEN 'alias' WHEN source[1] IN ('.', '/') THEN 'relative' ELSE 'package' END AS kind, source, nullif(d, '') AS default, CASE WHEN n = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(n, ','), {_TRIMMED}) END AS named, CASE WHEN starts_with(source, './') THEN 'web/' || substr(source, 3) END AS resolved_path FROM r"
)
_TREE = "c AS (SELECT DISTINCT n_regionkey AS r, 'r=region_' || n_regionkey AS a, 'n=' || replace(n_name, ' ', '_') AS b, 'segment=to_' || lower(c_mktsegment) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT * FROM c WHERE b <> 'n=NATION_5' AND s NOT IN ('segment=to_building', 'segment=to_machinery'))"
_PY_LINES = corpus.rows_sql({0: ["LIMIT = %size%", "Name = Optional[str]", "class Shape%k%(BaseModel):", "    # fields: side: int = %size%, label: str = '%word%'", "    async def area(self, scale: float = 1.0, *rest, unit = 'm', **more) -> float", "def make_%k%(items, /, key = None)", "def use_%k%(x)"]})
_OTHER_LINES = corpus.rows_sql({
    1: ["export interface Props%k%", "class Inner", "export const Card%k% = (props: Props): Item =>"], 2: ["func Add%k%(a int, b int) int", "type Pair%k% struct"], 3: ["pub fn add%k%(a: i32) -> i32", "struct Pair%k%"],
    4: ["public int size(int a)", "public class P%k%"], 5: ["def size(a)", "module M%k% def size(a) a # note end end"],
})
ORACLE_SQL = {
    "ca04_strip_comments": f"SELECT path, {_STRIP.format('text')} AS out FROM {F_SQL}",
    "ca04_strip_document_comments": f"SELECT doc_id, md5({_STRIP.format('text')}) AS digest FROM documents",
    "ca02_discover": f"WITH {_TREE} SELECT r AS target, b || '/' || s AS dir FROM k WHERE r IN (0, 2, 3)",
    "sc18_pruned_walk": f"WITH {_TREE} SELECT 'files' AS what, a || '/' || b || '/' || s AS dir FROM k WHERE r <> 1 UNION ALL SELECT 'entered', a || '/' || b || '/' || s FROM k WHERE r <> 1 UNION ALL SELECT DISTINCT 'entered', a || '/' || b FROM c WHERE r <> 1 AND b <> 'n=NATION_5' UNION ALL SELECT DISTINCT 'entered', a FROM c WHERE r <> 1",
    "ca04_by_language": r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[^\p{L}\p{N} ]', '', 'g')) AS lines FROM documents),
 o AS (SELECT doc_id, list_transform(lines, lambda x: CASE doc_id % 4 WHEN 0 THEN 'x = r#"/* ' || x || ' " // "#;  y = ' || chr(39) || '"' || chr(39) || '; ' WHEN 1 THEN 'x = ' || repeat(chr(39), 3) || '# ' || x || chr(10) || '//' || repeat(chr(39), 3) || ' ' || chr(10) || 'y = "#\"#" + ' || chr(39) || x || chr(39)
  WHEN 2 THEN 'x = `// ' || x || chr(10) || '/*`  + ' || chr(39) || '//' || chr(39) || ' + "' || x || ' /*" ' ELSE 'x = [=[--[[ ' || x || ']] ]=]  y = ' || chr(39) || '--' || chr(39) || ' .. "' || x || '" ' END) AS lines FROM l) SELECT doc_id, md5(array_to_string(lines, chr(10))) AS digest FROM o""",
    "ca05_decoded": f"SELECT path, path || 'é' AS out FROM {F_SQL}",
    "ca06_python_signatures": f"SELECT path, CAST(NULL AS VARCHAR) AS error, pos, signature FROM {_PY_LINES} UNION ALL SELECT path, 'SyntaxError', NULL, NULL FROM {F_SQL} WHERE {corpus.BROKEN}",
    "ca07_regex_signatures": f"SELECT path, CASE p_partkey % 8 WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' WHEN 4 THEN 'java' ELSE 'ruby' END AS lang, pos, signature FROM {_OTHER_LINES}",
    "ca08_call_graph": f"""SELECT path, CASE WHEN {corpus.BROKEN} THEN 'SyntaxError' END AS error, CASE WHEN NOT {corpus.BROKEN} THEN m END AS module, CASE WHEN x.c <> '' THEN m || '.' || x.c END AS caller, x.f AS callee, x.a AS args, x.l AS line, x.s AS is_async
 FROM (SELECT p_partkey, path, replace(path[:-4], '/', '.') AS m, unnest(CASE WHEN {corpus.BROKEN} THEN [NULL] ELSE [{{'c': '', 'f': 'lib.m' || p_partkey || '.Field', 'a': CAST([] AS VARCHAR[]), 'l': 13, 's': FALSE}}, {{'c': 'area', 'f': 'self.grow', 'a': ['scale'], 'l': 16, 's': TRUE}},
 {{'c': 'make_' || p_partkey, 'f': 'lib.m' || p_partkey || '.made', 'a': ['i'], 'l': 20, 's': FALSE}}, {{'c': 'use_' || p_partkey, 'f': '...join', 'a': [chr(39) || 'numpy' || chr(39), 'make_' || p_partkey || '(x)'], 'l': 24, 's': FALSE}}, {{'c': 'use_' || p_partkey, 'f': 'lib.m' || p_partkey || '.make_' || p_partkey, 'a': ['x'], 'l': 24, 's': FALSE}}] END) AS x FROM {F_SQL} WHERE p_partkey % 8 = 0)""",
    "ca09_definitions": f"""SELECT path, CASE WHEN {corpus.BROKEN} THEN 'SyntaxError' END AS error, x.k AS kind, x.c AS class, x.n AS name, x.a AS args FROM (SELECT p_partkey, path, unnest(CASE WHEN {corpus.BROKEN} THEN [NULL] ELSE [{{'k': 'class', 'c': 'Shape' || p_partkey, 'n': 'Shape' || p_partkey, 'a': CAST([] AS VARCHAR[])}},
 {{'k': 'method', 'c': 'Shape' || p_partkey, 'n': 'area', 'a': ['self', 'scale']}}, {{'k': 'function', 'c': NULL, 'n': 'make_' || p_partkey, 'a': ['key']}}, {{'k': 'function', 'c': NULL, 'n': 'use_' || p_partkey, 'a': ['x']}}] END) AS x FROM {F_SQL} WHERE p_partkey % 8 = 0)""",
    "ca10_context": f"""WITH f AS (SELECT * FROM {F_SQL}), s AS (SELECT path, string_agg(signature, chr(10) ORDER BY pos) AS body FROM (SELECT path, pos, signature FROM {_PY_LINES} UNION ALL SELECT path, pos, signature FROM {_OTHER_LINES}) GROUP BY path),
 m AS (SELECT 'original' AS mode, path, text AS body FROM f UNION ALL SELECT 'clean', path, {_STRIP.format('text')} FROM f UNION ALL SELECT 'signatures', path, coalesce(body, '') FROM f LEFT JOIN s USING (path))
 SELECT path, '---' || chr(10) || 'Filepath: ' || path || chr(10) || chr(10) || body || chr(10) AS body, mode FROM m UNION ALL SELECT path, line, 'tree' FROM ({TREE_SQL.format(f'SELECT path FROM {F_SQL}')} SELECT path, line FROM t)""",
    "ca17_python_imports": f"SELECT path, unnest(['os', 'json', 'typing', 'lib']) AS import_name, unnest([2, 2, 3, 4]) AS line FROM {F_SQL} WHERE p_partkey % 8 = 0 AND NOT {corpus.BROKEN}",
    "ca19_mention_context": f"SELECT path, unnest([2, 20, 24]) AS line, unnest(['json', 'numpy', 'numpy']) AS package, unnest(['code', 'comment', 'comment']) AS context FROM {F_SQL} WHERE p_partkey % 8 = 0 AND NOT {corpus.BROKEN}",
    "ca08_callers_over_files": f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, {corpus.NAMES['j']} AS j FROM part WHERE p_partkey % 8 = 0 AND NOT {corpus.BROKEN}), e AS (SELECT 'lib.m' || k || '.make_' || k AS caller, 'lib.m' || j || '.make_' || j AS callee FROM p UNION ALL SELECT 'lib.m' || k || '.use_' || k, 'lib.m' || k || '.make_' || k FROM p),
 r AS (SELECT caller, 1 AS depth FROM e WHERE callee = 'lib.m24.make_24' UNION SELECT e.caller, depth + 1 FROM r JOIN e ON e.callee = r.caller WHERE depth < 60) SELECT caller, min(depth) AS depth FROM r GROUP BY caller""",
    "jn11_transitive_callers": "WITH RECURSIVE e AS (SELECT DISTINCT 'f' || l_partkey AS caller, 'f' || l_suppkey AS callee FROM lineitem WHERE l_partkey % 10 = l_linenumber), r AS (SELECT callee AS function, caller FROM e WHERE callee IN ('f1', 'f2', 'f3') UNION SELECT function, e.caller FROM r JOIN e ON e.callee = r.caller) SELECT function, caller FROM r",
    "ca13_react_exports": _EXPORTS,
    "ca14_react_imports": _IMPORTS,
    "ca03_tree_text": f"{TREE_SQL.format(f'SELECT path FROM {F_SQL}')} SELECT row_number() OVER (ORDER BY parts) AS ordinal, line FROM t",
    "ca15_react_pipeline": f"SELECT e.path, e.named_exports AS exports, coalesce(i.imports, []) AS imports FROM ({_EXPORTS}) e LEFT JOIN (SELECT path, list_sort(list(DISTINCT source)) AS imports FROM ({_IMPORTS}) GROUP BY path) i ON e.path = i.path",
    "sc01_text_files": "SELECT n_name AS line FROM nation",
    "sc02_resolved_paths": """WITH p AS (SELECT p_partkey, string_split('/srv/app/' || CASE WHEN p_partkey % 3 = 0 THEN '../' ELSE './' END || p_brand || '/..' || repeat('/..', p_size % 4) || '//' || p_name, '/') AS parts FROM part)
 SELECT p_partkey, array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda d, x: CASE WHEN x[1] IN ('', '.') THEN d WHEN x[1] = '..' AND d[len(d)] NOT IN ('', '..') THEN d[1:len(d) - 1] ELSE list_append(d, x[1]) END), '/') AS out FROM p""",
    "sc03_append_list_delete": "SELECT 'line' AS what, r_name AS value FROM region UNION ALL SELECT 'line', n_name FROM nation UNION ALL SELECT 'files', 'true' UNION ALL SELECT 'deleted', '[True, True, False, False]'",
    "sc07_document_files": "SELECT md5(t) AS digest, count(*) AS n FROM (SELECT text AS t FROM documents UNION ALL SELECT html FROM pages) GROUP BY 1",
    "sc10_slides": "SELECT r_name || '.pptx' AS path, CAST(k AS INTEGER) AS slide, n_name AS title, n_name || chr(10) || 'of ' || r_name AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0",
    "sc17_reports": "SELECT kind, c_mktsegment, count(*) AS n, 'a \"b\", c' AS note FROM customer, (VALUES ('csv'), ('json')) v(kind) GROUP BY ALL",
    "sc18_file_tree": "SELECT DISTINCT 'r=region_' || n_regionkey || '/k=' || (n_nationkey % 3) AS dir FROM nation WHERE n_nationkey % 3 <> 1",
    "sc20_generated_names": "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'logs/' ELSE '' END || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_id || '.json' AS out FROM events",
    "stream_windowed_counts": "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
