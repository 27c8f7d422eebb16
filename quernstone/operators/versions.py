"""Snapshots and versions of files: each change makes a new table, as Parquet has no row-level changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after `changes`: a row of each key, the change's values where they aren't null.  Keys are unique on
    both sides; a soft-deleted row that is written again is live (`deleted_at` null)."""
    t, c = table.alias("t"), changes.alias("c")
    joined = t.join(c, [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full_outer")
    hit = F.coalesce(*(F.col(f"c.{k}") for k in keys)).isNotNull()
    cols = []
    for name in table.columns:
        if name == "deleted_at":
            cols.append(F.when(~hit, F.col("t.deleted_at")).alias(name))
        else:
            cols.append((F.coalesce(F.col(f"c.{name}"), F.col(f"t.{name}")) if name in changes.columns else F.col(f"t.{name}")).alias(name))
    return joined.select(*cols)


def soft_delete(table: DataFrame, ids: DataFrame, key: str, at: Column) -> DataFrame:
    marked = table.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).select(*table.columns)


def numbered(writes: DataFrame, file: list[str], order: list[str], start: str | None = None) -> DataFrame:
    """Writes with version_number, from 1 for each file in the given order; start: a column to count on from."""
    n = F.row_number().over(W.Window.partitionBy(*file).orderBy(*order))
    return writes.withColumn("version_number", (n + F.coalesce(F.col(start), F.lit(0)) if start else n).cast("int"))


def latest(versions: DataFrame, file: list[str]) -> DataFrame:
    """Each file's row with the highest version_number."""
    rest = [c for c in versions.columns if c not in file]
    return versions.groupBy(*file).agg(F.max_by(F.struct(*rest), "version_number").alias("x")).select(*file, "x.*")


def at_version(versions: DataFrame, file: str, wanted: DataFrame) -> DataFrame:
    """wanted: file, version_number (null: the latest)."""
    last = versions.groupBy(file).agg(F.max("version_number").alias("_last"))
    w = wanted.join(last, file).select(file, F.coalesce("version_number", "_last").alias("version_number"))
    return versions.join(w, [file, "version_number"])


def restore(versions: DataFrame, file: str, wanted: DataFrame) -> DataFrame:
    """The versions and, for each wanted (file, version_number), a copy as the file's next version, which says so."""
    last = versions.groupBy(file).agg(F.max("version_number").alias("_last"))
    copied = versions.join(wanted, [file, "version_number"]).join(last, file)
    said = F.concat(F.lit("Restored from version "), F.col("version_number").cast("string"))
    fresh = {"version_number": F.col("_last") + 1, "change_summary": said}
    return versions.unionByName(copied.select(*(fresh.get(c, F.col(c)).alias(c) for c in versions.columns)))


def keep_last(history: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in history.columns if c not in key]
    return history.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def resolve_user(explicit: Column, configured: Column, request: Column) -> Column:
    """The first of the three that isn't empty, else an empty text."""
    known = [F.when(c != "", c) for c in (explicit, configured, request)]
    return F.coalesce(*known, F.lit(""))
