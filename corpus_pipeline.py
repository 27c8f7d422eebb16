"""A corpus pipeline: quality, language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents for what it keeps, but for the last one,
which returns packed pieces.  Every stage works on all rows of the one before, and models are learned from what the
stage is given.

A stage sets the session's spark.sql.execution.arrow.maxBytesPerBatch to BATCH and leaves it so, as what the stage returns
runs later: with Spark's 64 MB, the JVM (outside its heap) and Python both hold that much text and more for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import langid, mixing, packing, parityjoin, quality
from quernstone.llm.storage import kept

BATCH = "4m"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_key(docs: DataFrame) -> DataFrame:
    """The columns of documents, which Python gets in small batches."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return docs.select(*(f"`{c}`" for c in COLUMNS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, predicts to be good; all where none is labelled."""
    docs = _with_key(docs)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs.select(*COLUMNS)
    return quality.annotate(docs, model).where("predicted = 1").select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; lang becomes the predicted language."""
    docs = _with_key(docs)
    marked = langid.annotate(docs, langid.train(docs)).where("not rejected")
    return marked.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similarity links, that with the smallest doc_id; of repeated rows, one.

    A document with a null doc_id is linked with nothing and stays.
    """
    docs = _with_key(docs)
    found = kept(parityjoin.jaccard_components(docs).where("doc_id is not null"), "pipeline-groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = kept(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    left = docs.join(_sized(gone), "doc_id", "left_anti")
    if not again.limit(1).count():
        return left
    again = _sized(again)
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def _sized(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """ids, broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= most else ids


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, at most three times."""
    taken = mixing.mix(_with_key(docs), carried=COLUMNS).where("repeats > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1,024 tokens, each with all sources in proportion."""
    return packing.pack(_with_key(docs), packing.default_tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]
#: A classifier's verdicts and token ids can't be told in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, f"pipeline-{i}")
    return docs
