"""Input columns by name, whatever else a table holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
