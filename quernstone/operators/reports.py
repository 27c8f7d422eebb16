"""Counts and lists about files, packages, names and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import case, paths

#: Severity of a mention's context, the lowest first.
SEVERITY = {"code": 0, "import": 0, "string": 1, "comment": 2, "text": 3}


def extension_histogram(files: DataFrame, path: str = "path") -> DataFrame:
    """ext, n_files, n_dirs; files without a suffix count under "(no ext)"."""
    ext = paths.extension(F.col(path))
    rows = files.select(F.when(ext == "", "(no ext)").otherwise(ext).alias("ext"), paths.dirname(F.col(path)).alias("dir"))
    return rows.groupBy("ext").agg(F.count("*").alias("n_files"), F.countDistinct("dir").alias("n_dirs"))


def exclusion_footer(counts: DataFrame) -> DataFrame:
    """One row: "n ext" of all extensions, by falling count and then by name.  counts: ext, n_files."""
    x = F.array_sort(F.collect_list(F.struct((-F.col("n_files")).alias("k"), "ext", "n_files")))
    return counts.agg(F.array_join(F.transform(x, lambda r: F.concat(r["n_files"].cast("string"), F.lit(" "), r["ext"])), ", ").alias("footer"))


def collisions(exports: DataFrame) -> DataFrame:
    """name, n, paths: names that two or more files export."""
    return exports.select("name", "path").distinct().groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where("n > 1")


def top(df: DataFrame, by: list[Column], n: int = 10) -> DataFrame:
    return df.orderBy(*by).limit(n)


def package_counts(details: DataFrame, packages: DataFrame) -> DataFrame:
    """package, file_count: distinct files of each package, 0 for those of `packages` without any."""
    used = details.select("package", "file").distinct().groupBy("package").agg(F.count("*").alias("file_count"))
    unused = packages.select("package").distinct().join(used, "package", "left_anti").withColumn("file_count", F.lit(0).cast("long"))
    return used.unionByName(unused)


def resolve_packages(imports: DataFrame, names: DataFrame) -> DataFrame:
    """package, file: names (import_name, package) may give several packages for one import."""
    left = imports.select(case.package_name(F.col("import_name")).alias("import_name"), "file")
    return left.join(names.select(case.package_name(F.col("import_name")).alias("import_name"), "package").distinct(), "import_name").select("package", "file").distinct()


def without_companions(unused: DataFrame, used: DataFrame, companions: DataFrame) -> DataFrame:
    """Unused packages but for those whose primary (companions: primary, companion) is used."""
    gone = companions.join(used.select(F.col("package").alias("primary")).distinct(), "primary", "left_semi").select(F.col("companion").alias("package"))
    return unused.join(gone, "package", "left_anti")


def dominant_context(mentions: DataFrame) -> DataFrame:
    """package, file, context, lines: the context of least severity and all lines in order."""
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))[F.col("context")]
    return mentions.groupBy("package", "file").agg(F.min_by("context", F.struct(rank, F.col("context"))).alias("context"), F.array_sort(F.collect_set("line")).alias("lines"))


def action_tiers(contexts: DataFrame) -> DataFrame:
    """package, code_files, text_files, total; `code` and `import` are code.  Ordered by whether code uses it, total and name."""
    code = F.col("context").isin("code", "import")
    out = contexts.groupBy("package").agg(F.count_if(code).alias("code_files"), F.count_if(~code).alias("text_files"), F.count("*").alias("total"))
    return out.orderBy((F.col("code_files") > 0), "total", "package")


def staleness(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """module, newest, stale: the newest minute of a module's files against its stamp's.  files: module, modified."""
    newest = files.groupBy("module").agg(F.max(F.date_trunc("minute", "modified")).alias("newest"))
    return newest.join(stamps, "module", "left").select("module", "newest", (F.col("stamp").isNull() | (F.col("newest") > F.date_trunc("minute", "stamp"))).alias("stale"))


def grouped_messages(messages: DataFrame) -> DataFrame:
    """is_error, message, ext, paths: distinct paths of each message and extension."""
    ext = paths.extension(F.col("path"))
    return messages.groupBy("is_error", "message", ext.alias("ext")).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def repeated_imports(imports: DataFrame) -> DataFrame:
    """Second and later imports of a source in a file."""
    n = F.row_number().over(W.Window.partitionBy("path", "source").orderBy("pos"))
    return imports.withColumn("_n", n).where("_n > 1").drop("_n")


def covered(rows: DataFrame, prefixes: DataFrame, name: str, pos: str) -> DataFrame:
    """prefix, n, first, last of rows whose name is or lies under a prefix (the first that matches, by `seq`); for the
    rest, a row each with its own name as prefix.  prefixes (prefix, seq) meet each name's ancestors by equality."""
    r = rows.select(F.struct(pos, name).alias("_id"), F.explode(F.concat(F.array(name), paths.ancestors(F.col(name)))).alias("prefix"))
    first = r.join(prefixes.select("prefix", "seq"), "prefix").groupBy("_id").agg(F.min_by("prefix", "seq").alias("prefix"))
    one = rows.select(F.struct(pos, name).alias("_id"), name, pos).join(first, "_id", "left")
    under = one.where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"), F.min_by(name, pos).alias("first"), F.max_by(name, pos).alias("last"))
    return under.unionByName(one.where("prefix is null").select(F.col(name).alias("prefix"), F.lit(1).cast("long").alias("n"), F.col(name).alias("first"), F.col(name).alias("last")))


def dependency_sets(edges: DataFrame, most: int = 15) -> DataFrame:
    """module, internal, external, n_external: sorted distinct names; external is null if there are more than `most`."""
    inner, outer = F.array_sort(F.collect_set(F.when(F.col("is_internal"), F.col("name")))), F.array_sort(F.collect_set(F.when(~F.col("is_internal"), F.col("name"))))
    out = edges.groupBy("module").agg(inner.alias("internal"), outer.alias("external"))
    return out.select("module", "internal", F.when(F.size("external") <= most, F.col("external")).alias("external"), F.size("external").alias("n_external"))


def combined(files: DataFrame, exports: DataFrame, imports: DataFrame) -> DataFrame:
    """path, exports, imports: sorted names and sources of each file, empty lists where it has none."""
    e = exports.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("exports"))
    i = imports.groupBy("path").agg(F.array_sort(F.collect_set("source")).alias("imports"))
    none = F.array().cast("array<string>")
    return files.select("path").distinct().join(e, "path", "left").join(i, "path", "left").select("path", F.coalesce("exports", none).alias("exports"), F.coalesce("imports", none).alias("imports"))


def invalid_imports(imports: DataFrame, files: DataFrame, probe: tuple[str, ...] = ()) -> DataFrame:
    """Imports whose resolved path is no file; packages (null resolved_path) never are.  probe: suffixes to try too."""
    at = imports.where("resolved_path is not null").withColumn("_p", paths.normal(F.col("resolved_path")))
    tries = F.array(F.col("_p"), *(F.concat("_p", F.lit(s)) for s in probe))
    known = files.select(paths.normal(F.col("path")).alias("_t")).distinct()
    bad = at.withColumn("_id", F.struct("path", "pos", "source"))
    hit = bad.select("_id", F.explode(tries).alias("_t")).join(known, "_t", "left_semi").select("_id").distinct()
    return bad.join(hit, "_id", "left_anti").drop("_p", "_id")


def resolve_alias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds resolved_path: the first alias (by seq) that the source begins with, its target and the rest.  aliases
    (prefix, target, seq) meet the sources' beginnings of the lengths that aliases have, by equality."""
    lengths = aliases.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("_lengths"))  # one row, as long as the longest alias at most
    sources = imports.select("source").distinct().join(F.broadcast(lengths), how="cross")
    starts = F.filter("_lengths", lambda n: n <= F.length("source"))
    tries = sources.select("source", F.explode(F.transform(starts, lambda n: F.substr("source", F.lit(1), n))).alias("prefix"))
    path = paths.normal(F.concat("target", F.lit("/"), F.substr("source", F.length("prefix") + 1)))
    found = tries.join(aliases, "prefix").groupBy("source").agg(F.min_by(path, "seq").alias("resolved_path"))
    return imports.join(found, "source", "left").select(*imports.columns, "resolved_path")


def first_wins(exports: DataFrame) -> DataFrame:
    """name, path, is_default, chosen: one file for each name, default exports first, then by path; the rest aren't chosen."""
    order = W.Window.partitionBy("name").orderBy(F.col("is_default").desc(), "path")
    return exports.withColumn("chosen", F.row_number().over(order) == 1)


def barrel_lines(exports: DataFrame) -> DataFrame:
    """not_default, path, name, line: the lines of an index that exports every name once; later files of a name are
    comments.  The first three columns are the lines' order."""
    stem = F.regexp_replace("path", r"\.[a-zA-Z0-9]+$", "")
    line = F.concat(F.when(F.col("is_default"), "export { default as ").otherwise("export { "), "name", F.lit(" } from './"), stem, F.lit("';"))
    return first_wins(exports).select((~F.col("is_default")).alias("not_default"), "path", "name", F.when(F.col("chosen"), line).otherwise(F.concat(F.lit("// "), line)).alias("line"))


#: What orders the lines of an index.
BARREL_ORDER = ["not_default", "path", "name"]


def upstream_callers(calls: DataFrame, imports: DataFrame, callables: DataFrame, module: str) -> DataFrame:
    """function, caller, path: calls from files outside a module, which import it, of its callables, in order."""
    outside = imports.where(F.col("source").startswith(module) & ~F.col("path").startswith(module.replace(".", "/"))).select("path").distinct()
    found = calls.join(outside, "path", "left_semi").join(callables.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")
    return found.select(F.col("callee").alias("function"), "caller", "path").distinct().orderBy("function", "caller", "path")
