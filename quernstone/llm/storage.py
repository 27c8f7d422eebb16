"""Places for intermediate tables that every executor can read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path under spark.checkpoint.dir; on one machine (tests), a folder of its own is set where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        base = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage ends there, so lost executors cost nothing."""
    return stored(df, shared_dir(df.sparkSession, what), compression)


def stored(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Intermediate tables of one computation, which go together when nothing reads them any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.tables = spark, shared_dir(spark, what), 0

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.tables += 1
        return stored(df, f"{self.root}/{self.tables}-{what}")

    def clear(self) -> None:
        drop(self.spark, self.root)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder whose rows no later step reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """While it lasts, Spark gives Python about `size` bytes at once, however long the rows are; what runs later isn't bound.

    By default a batch of texts has up to 64 MB, which the JVM (outside its heap) and Python both hold for each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)
