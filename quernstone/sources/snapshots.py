"""Snapshots of a table in buckets: a change writes anew only the buckets that it falls in.

A table's folder has `data/<snapshot>/bucket=<b>` with the rows of a bucket as one snapshot wrote them, and
`manifest/<snapshot>`, a small table of (bucket, written): which snapshot's files hold each bucket.  A manifest is written last, so a
snapshot that was cut short isn't there, and readers of older ones see what they saw.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import versions


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("bucket", IntegerType())])


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, root: str, number: int, written: dict[int, int]) -> None:
    spark.createDataFrame(sorted(written.items()), "bucket int, written int").coalesce(1).write.parquet(f"{root}/manifest/{number}")


def _write(rows: DataFrame, root: str, number: int, bucket: Column, buckets: int) -> None:
    """A file a bucket: rows of one lie in one partition, as many partitions as buckets."""
    dealt = rows.withColumn("bucket", bucket)
    dealt.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{root}/data/{number}")


def _read(spark: SparkSession, root: str, written: dict[int, int], schema) -> DataFrame:
    """Rows of the named buckets, each from the snapshot that wrote it, with their bucket and that snapshot."""
    paths: dict[int, list[str]] = {}
    for bucket, number in written.items():
        paths.setdefault(number, []).append(f"{root}/data/{number}/bucket={bucket}")
    parts = [spark.read.schema(schema).option("basePath", f"{root}/data/{number}").parquet(*sorted(of)).withColumn("written", F.lit(number)) for number, of in sorted(paths.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema).withColumn("written", F.lit(None).cast("int"))


def manifest(spark: SparkSession, root: str, number: int) -> dict[int, int]:
    """The snapshot that wrote each bucket with rows; at most as many entries as a table has buckets."""
    return {r.bucket: r.written for r in spark.read.parquet(f"{root}/manifest/{number}").toLocalIterator()}


def create(rows: DataFrame, root: str, keys: list[str], buckets: int = 64, bucket: Column | None = None) -> None:
    """Snapshot 0 of a table; bucket: another rule for a row's bucket, below `buckets`."""
    bucket = bucket_of(keys, buckets) if bucket is None else bucket
    _write(rows, root, 0, bucket, buckets)
    have = rows.sparkSession.read.parquet(f"{root}/data/0").select("bucket").distinct() if rows.limit(1).count() else None
    _commit(rows.sparkSession, root, 0, {r.bucket: 0 for r in have.toLocalIterator()} if have is not None else {})


def read(spark: SparkSession, root: str, number: int, schema) -> DataFrame:
    """The table as of a snapshot, with the snapshot that wrote a row's file (written).  schema: of the table's rows."""
    return _read(spark, root, manifest(spark, root, number), _with_bucket(schema)).drop("bucket")


def change(spark: SparkSession, root: str, number: int, changes: DataFrame, schema, keys: list[str], buckets: int = 64, bucket: Column | None = None) -> int:
    """Upserts `changes` into snapshot `number` and gives the next one's number: only buckets with changes are read and written.

    Keys are unique on both sides; what a change leaves out or null stays (see `versions.upsert`).
    """
    bucket = bucket_of(keys, buckets) if bucket is None else bucket
    written = manifest(spark, root, number)
    dealt = changes.withColumn("bucket", bucket)
    touched = sorted(r.bucket for r in dealt.select("bucket").distinct().toLocalIterator())
    old = _read(spark, root, {b: written[b] for b in touched if b in written}, _with_bucket(schema)).drop("written")
    after = versions.upsert(old, dealt, [*keys, "bucket"])
    after.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{root}/data/{number + 1}")
    _commit(spark, root, number + 1, {**written, **dict.fromkeys(touched, number + 1)})
    return number + 1
