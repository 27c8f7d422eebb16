"""Inputs that Spark and SQL build alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key to two tasks a core at least, for work that takes long beside the rows' bytes."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


def quote(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str) -> str:
    """SQL of a constant table of texts, for DuckDB."""
    body = ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def values_df(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n.strip()} string" for n in names.split(",")))


#: What stands for a row's own key and text in texts dealt to rows.
KEY, OWN = "{n}", "{t}"


def _list_sql(texts: list[str | None]) -> str:
    return "[" + ", ".join(quote(x) for x in texts) + "]"


def dealt_sql(rows: list[tuple], names: str, table_name: str, key: str, own: str) -> str:
    """Rows of a table with texts of the given ones by turns, filled with the row's key and own text, as `id` and names."""
    columns = [f"replace(replace({_list_sql([r[i] for r in rows])}[{key} % {len(rows)} + 1], '{KEY}', CAST({key} AS VARCHAR)), '{OWN}', {own}) AS {n.strip()}" for i, n in enumerate(names.split(","))]
    return f"SELECT {key} AS id, {', '.join(columns)} FROM {table_name}"


def dealt_df(spark: SparkSession, sf_dir: str, rows: list[tuple], names: str, table_name: str, key: str, own: str) -> DataFrame:
    place = (F.col(key) % len(rows) + 1).cast("int")
    columns = [F.replace(F.replace(F.element_at(F.array(*(F.lit(r[i]) for r in rows)), place), F.lit(KEY), F.col(key).cast("string")), F.lit(OWN), F.col(own)).alias(n.strip()) for i, n in enumerate(names.split(","))]
    return table(spark, sf_dir, table_name).select(F.col(key).alias("id"), *columns)
