"""Texts whose lines have an order, written and read by many tasks.

Lines are dealt by ranges of their order, so the files of a folder, by name, hold the lines in order: no task and no row has all
of them.  Reading numbers them by prefix sums: how many lines each split of a file has (a row a split), and a line's place in its
split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def write_lines(lines: DataFrame, line: str, order: list[str | Column], path: str, parts: int | None = None, append: bool = False) -> None:
    """The column `line` as text files in the order of `order`, which tells all rows apart; parts: the number of files.

    A null line is an empty one; a line's own line breaks make several lines of it.
    """
    ranges = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    ranges.sortWithinPartitions(*order).select(F.coalesce(line, F.lit("")).alias("value")).write.mode("append" if append else "overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ordinal (from 1), line of the files below a path, by the files' names."""
    at = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")
    )
    splits = at.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.Window.orderBy("file", "start").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before.alias("before"))
    return at.join(F.broadcast(splits), ["file", "start"]).select((F.col("before") + F.col("place") - F.col("first") + 1).alias("ordinal"), "line")
