"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept


def components(links: DataFrame, keep=kept) -> DataFrame:
    """node, root for each node of links (a, b: long): equal roots for nodes that links connect.

    Each round sends a node to the smallest of itself and its neighbours and rewrites the links between what is left;
    with node numbers that are hashes, few rounds are needed.  Every round's map and links are tables in the shared
    folder, so nothing is gathered on the driver but a count, and lost executors repeat one round at most.  keep writes them.
    """
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    maps = []
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = keep(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "links-map")
        maps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").where("root_a <> root_b")
        edges = keep(moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    labels = maps[0]
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        labels = labels.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return labels
