"""Calls across files, and who reaches a function at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch_dir


def resolved(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller, callee of each call inside a function, with what the file's imports say of the callee's first name.

    calls: path, module, caller, callee; symbols: path, local, target.  A plain call of an imported name is one of its target,
    `name.attr` one of the target's member; what no import binds stays as it is.
    """
    inner = F.expr("startswith(callee, concat(module, '.'))")
    bare = F.when(inner, F.substr("callee", F.length("module") + 2))
    owner = F.when(~inner, F.regexp_extract("callee", r"^([^.]+)\.[^.]+$", 1))
    rows = calls.where("caller is not null").select("path", "caller", "callee", F.coalesce(bare, owner).alias("local"), F.regexp_extract("callee", r"(\.[^.]+)$", 1).alias("member"), inner.alias("bare"))
    known = symbols.groupBy("path", "local").agg(F.max("target").alias("target"))
    said = F.when(F.col("target").isNull(), F.col("callee")).when(F.col("bare"), F.col("target")).otherwise(F.concat("target", "member"))
    return rows.join(known, ["path", "local"], "left").select("caller", said.alias("callee")).distinct()


def reaching(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """function, caller, depth: all that call a function, directly (depth 1) or through others, by the shortest way.

    edges: caller, callee; functions: function.  Round by round, only callers found last are followed, and what was found
    before isn't followed again, so cycles end; a function that reaches itself is its own caller.  A round's rows are a table
    in the shared folder, so nothing is worked out twice and lost executors repeat one round.
    """
    spark = edges.sparkSession
    at = scratch_dir(spark, "callers")
    edges.select("caller", "callee").distinct().write.parquet(f"{at}/edges")
    edges = spark.read.parquet(f"{at}/edges")
    fresh = functions.select(F.col("function").alias("function"), F.col("function").alias("callee")).distinct()
    rounds: list[DataFrame] = []
    while True:
        step = fresh.join(edges, "callee").select("function", "caller").distinct()
        if rounds:
            step = step.join(reduce(DataFrame.unionByName, rounds).select("function", "caller"), ["function", "caller"], "left_anti")
        path = f"{at}/{len(rounds)}"
        step.withColumn("depth", F.lit(len(rounds) + 1)).write.parquet(path)
        found = spark.read.parquet(path)
        rounds.append(found)
        if not found.limit(1).count():
            return reduce(DataFrame.unionByName, rounds)
        fresh = found.select("function", F.col("caller").alias("callee"))
