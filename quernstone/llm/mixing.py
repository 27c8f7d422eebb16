"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern, so the flow problem has a
node per pattern and per source whatever the number of documents.  Each pattern's words may be used up to `max_repeats`
times at convex costs: the first use is free, and each further use costs more than the one before.  The flow of a
pattern then says how often its documents are taken: all of them floor(flow / size) times, and those that come first
in a seeded order once more.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .columns import read
from .storage import kept

WEIGHTS = (5, 2, 1)
#: Patterns that the flow on the driver takes, and those whose plan is broadcast.
MAX_PATTERNS, BROADCAST_PATTERNS = 1_000_000, 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Target of each source: `total` in proportion to the weights, none above `most` times its size."""
    out, rest, free = {}, float(total), {s for s in sizes if sizes[s] > 0}
    while free:
        level = rest / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > most * sizes[s]}
        if not over:
            break
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        free -= over
    return {s: out.get(s, level * weights[s] if s in free else 0.0) for s in sizes}


def min_cost_flow(patterns: list[tuple[tuple, int]], quota: dict, max_repeats: int) -> list[dict]:
    """Words that each pattern gives to each of its sources, at the least cost of repetition.

    patterns: (its sources, its words).  Cost levels are served in order: with costs that rise with the use, a flow
    that is largest at each level in turn, with rerouting of earlier flow, is one of least cost.
    """
    given: list[dict] = [dict.fromkeys(members, 0) for members, _ in patterns]
    need = dict(quota)
    by_source: dict = {}
    for i, (members, _) in enumerate(patterns):
        for s in members:
            by_source.setdefault(s, []).append(i)
    for i, (members, size) in enumerate(patterns):  # a source whose documents are in no other has no choice
        if len(members) == 1 and len(by_source[members[0]]) == 1:
            given[i][members[0]] = min(need.pop(members[0], 0), size * max_repeats)
    patterns = [(members if any(s in need for s in members) else (), size) for members, size in patterns]
    for use in range(1, max_repeats + 1):
        spare = [size * use - sum(g.values()) if members else 0 for (members, size), g in zip(patterns, given, strict=True)]
        blocked: set = set()
        waiting = deque(s for s in need if need[s] > 0)
        while True:
            while waiting and (need[waiting[0]] <= 0 or waiting[0] in blocked):
                waiting.popleft()
            if not waiting:
                break
            short = waiting[0]
            came: dict = {("s", short): None}  # search from the source back to a pattern with words to spare
            queue, end = deque([("s", short)]), None
            while queue and end is None:
                kind, x = queue.popleft()
                for y in by_source.get(x, ()) if kind == "s" else [s for s, v in given[x].items() if v > 0]:
                    node = ("p" if kind == "s" else "s", y)
                    if node in came:
                        continue
                    came[node] = (kind, x)
                    if node[0] == "p" and spare[y] > 0:
                        end = node
                        break
                    queue.append(node)
            if end is None:
                blocked |= {x for kind, x in came if kind == "s"}
                continue
            path, node = [], end
            while node is not None:
                path.append(node)
                node = came[node]
            moved = min([need[short], spare[end[1]], *(given[p[1]][s[1]] for s, p in zip(path[1::2], path[2::2], strict=False))])
            for p, s in zip(path[::2], path[1::2], strict=True):
                given[p[1]][s[1]] += moved
            for s, p in zip(path[1::2], path[2::2], strict=False):
                given[p[1]][s[1]] -= moved
            spare[end[1]] -= moved
            need[short] -= moved
    return given


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = 3, seed: int = 17, sources: str = "source", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, repeats, taken of each document, and the carried columns.

    docs: doc_id, text, `sources` (a string or an array of strings: overlapping sources) and the carried columns, which
    may be text and `sources` but none of the results; others are left out.  Sources in the order of code points, null
    last, weigh `weights`, repeating; an empty array is the null source.  A null or empty text has size 0 and is taken 0
    times.  source_size and target are those of the first of a document's sources.  Equal rows have the same place in
    the seeded order; which of them is taken once more is open, but how many are is not.  An empty table gives no rows.

    The seeded order is that of md5(seed:doc_id).  Its first three hex digits deal each pattern's documents into 4,096
    buckets, so that only the bucket at the border needs a running sum over single documents.  The table is read twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("`doc_id`").alias("_id"), F.col("`text`").alias("_text"), F.col(f"`{sources}`").alias("_in"), *(f"`{c}`" for c in carried))
    if not isinstance(rows.schema["_in"].dataType, T.ArrayType):
        rows = rows.withColumn("_in", F.array("_in"))
    members = F.when(F.size("_in") > 0, F.array_sort(F.array_distinct("_in"))).otherwise(F.array(F.lit(None).cast("string")))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumns({"_in": members, "_place": place, "size": n_words(F.col("_text"))}).drop("_text")
    rows = rows.withColumns({"_key": F.to_json("_in"), "_bucket": F.substring("_place", 1, 3)})

    buckets = kept(rows.groupBy("_key", "_bucket").agg(F.first("_in").alias("_in"), F.sum("size").alias("words")), "mix-buckets")
    patterns = [(tuple(r[1]), r[2], r[0]) for r in buckets.groupBy("_key").agg(F.first("_in"), F.sum("words")).limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: the flow is solved on the driver; merge small sources first")
    patterns.sort(key=lambda p: p[2])
    sizes: dict = {}
    for member, n, _ in patterns:
        for s in member:
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = shares(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(p[1] for p in patterns), max_repeats)
    given = min_cost_flow([p[:2] for p in patterns], {s: round(t) for s, t in target.items()}, max_repeats)
    plan = [(k, sizes[m[0]], target[m[0]], sum(g.values()) // n if n else 0, sum(g.values()) % n if n else 0) for (m, n, k), g in zip(patterns, given, strict=True)]
    small = F.broadcast if len(plan) <= BROADCAST_PATTERNS else (lambda df: df)  # a row a pattern
    plan = spark.createDataFrame(plan, "_key string, source_size long, target double, _all long, _extra long")

    running = W.Window.partitionBy("_key").orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    before = buckets.withColumn("_before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    border = before.join(small(plan), "_key").where("_before < _extra and _before + words >= _extra").select("_key", F.col("_bucket").alias("_border"), "_before")
    rows = rows.join(small(plan.join(border, "_key", "left")), "_key")
    upto = W.Window.partitionBy("_key").orderBy("_place", "_id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    middle = F.col("_before") + F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("size") / 2
    inside = rows.where("_bucket = _border").withColumn("_more", (middle <= F.col("_extra")).cast("int"))
    outside = rows.where("_border is null or _bucket <> _border").withColumn("_more", F.when(F.col("_bucket") < F.col("_border"), 1).otherwise(0))
    repeats = F.when(F.col("size") > 0, F.least(F.col("_all") + F.col("_more"), F.lit(max_repeats))).otherwise(0)
    out = inside.unionByName(outside).withColumn("repeats", repeats.cast("int"))
    return out.select(*([] if "doc_id" in carried else [F.col("_id").alias("doc_id")]), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).cast("long").alias("taken"), *(f"`{c}`" for c in carried))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all `documents`; see `mix` for nulls, ties, repeated rows and empty tables."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
