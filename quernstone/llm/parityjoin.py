"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct word shingles, each hashed to 64 bits.  In a bit sketch every shingle flips one
bit, so the Hamming distance of two sketches is at most the size of the sets' symmetric difference, which for sets of
sizes a and b with similarity t is at most d = (1 - t) / (1 + t) * (a + b).  Sizes are dealt into bands such that a pair
lies in one band or in two next to each other.  For each band (as the lower one of a pair) the sketch, of 2^32 bits a
block, is cut into m > d blocks by the shingles' upper hash bits: flipping d bits leaves at least m - d blocks as they
are, so similar documents agree in a block (pigeonhole).  Blocks with few shingles say little; a document leaves them
out while fewer than m - d of its blocks are so light, and then an agreeing block that is not remains for every partner.

Documents that share a block's key meet in a bucket.  Each is first compared with one hub, that with which it shares most
keys; candidates are filtered by size and by a dense sketch of two to four bits a shingle and verified on the sets themselves.  The links
found so far make components; a group with members in different components then compares those by sketches, and what
passes is verified.  So no link between components is lost, and buckets are never expanded into all pairs of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .columns import narrow, read
from .components import components
from .storage import Shelf, kept, small_batches

SKETCH_BITS = 2_048
LEAST_BITS, MOST_BITS = 256, 1 << 18
BROADCAST_ROWS = 500_000
CELL = 256


def shingle_sets(texts: tv.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, and their offsets; a text of fewer words is one shingle."""
    w = tv.words(texts, lower=True)
    hashes, _ = tv.windows(w, width)
    counts = np.diff(w.offsets)
    offsets = np.concatenate([[0], np.cumsum(np.where(counts >= width, counts - width + 1, counts > 0))])
    out = np.empty(offsets[-1], np.uint64)
    full = np.flatnonzero(counts >= width)
    out[tv.ragged(offsets[full], np.diff(offsets)[full])] = hashes
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows = w.offsets[short][:, None] + np.arange(n)
            whole, _ = tv.windows(tv.Words(w.hashes[rows.ravel()], np.zeros(0), np.zeros(0), np.arange(len(short) + 1) * n), n)
            out[offsets[short]] = tv.mix(whole + np.uint64(n))
    for i in full:
        out[offsets[i] : offsets[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[offsets]


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set; that of an empty set is 0."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = tv.mix(np.add.reduceat(tv.mix(hashes), offsets[full]) + sizes[full].astype(np.uint64))
    return out.view(np.int64)


def dense_sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, bits = len(offsets) - 1, np.uint64(SKETCH_BITS - 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    flips = np.bincount(owner * SKETCH_BITS + ((hashes >> np.uint64(20)) & bits).astype(np.int64), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(bool).reshape(n, SKETCH_BITS), axis=1)


def sized_sketches(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Parity sketches as wide as the sets are large: of the power of two that is at least twice the size, within bounds.

    Folding one by halves gives the sketch of half the width, so that those of different widths can be compared.
    """
    sizes = np.diff(offsets)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    starts = np.concatenate([[0], np.cumsum(bits)])
    flips = np.zeros(starts[-1], np.uint8)
    np.add.at(flips, np.repeat(starts[:-1], sizes) + ((hashes >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, sizes)), np.uint8(1))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((starts // 8).astype(np.int32)), pa.py_buffer(np.packbits(flips & 1))])


@lru_cache
def band_edges(percent: int, most: int) -> np.ndarray:
    """Band k has sizes edges[k] to edges[k + 1] - 1; the larger set of a pair is in its partner's band or the next."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, 100 * (edges[-1] - 1) // percent + 1))
    edges.append(max(edges[-1] + 1, 100 * (edges[-1] - 1) // percent + 1))
    return np.array(edges)


def blocks_of_band(edges: np.ndarray, band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """d and m of pairs whose smaller set is in the band."""
    a = edges[band + 1] - 1
    d = (100 - percent) * (a + 100 * a // percent) // (100 + percent)
    return d, d + d // 3 + 1


def block_keys(hashes: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks that each text is entered under, and the text's index."""
    return banded_keys(hashes, offsets, percent)[:2]


def banded_keys(hashes: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the blocks that each text is entered under, the text's index, and the band of the key's pairs."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = band_edges(percent, 1 << int(sizes.max()).bit_length())
    own = np.searchsorted(edges, sizes[full], "right") - 1
    all_owner, upper = np.repeat(np.arange(len(full)), sizes[full]), hashes >> np.uint64(32)
    bits = tv.mix(hashes & np.uint64(0xFFFFFFFF))
    keys, owners, bands = [], [], []
    for down in (0, 1):
        use = own >= down
        band = np.maximum(own - down, 0)
        d, m = blocks_of_band(edges, band, percent)
        block = (upper * m[all_owner].astype(np.uint64)) >> np.uint64(32)
        starts = tv.group_starts(all_owner, block)
        load = np.diff(np.append(starts, len(block)))
        who, block = all_owner[starts], block[starts]
        parity = np.bitwise_xor.reduceat(bits, starts)
        salt = tv.mix(band[who].astype(np.uint64) << np.uint64(40) | block)
        filled = np.bincount(who, minlength=len(full))
        light = m - filled + np.bincount(who, load == 1, len(full)).astype(np.int64)
        least = np.where(light < m - d, 2, np.where(m - filled < m - d, 1, 0))
        chosen = use[who] & (load >= least[who])
        keys.append(tv.mix(parity[chosen] ^ salt[chosen]))
        owners.append(full[who[chosen]])
        bands.append(band[who[chosen]])
        for i in np.flatnonzero(use & (least == 0)):  # a text with very few shingles: empty blocks count too
            empty = np.setdiff1d(np.arange(m[i]), block[who == i].astype(np.int64)).astype(np.uint64)
            keys.append(tv.mix(tv.mix(np.uint64(band[i]) << np.uint64(40) | empty)))
            owners.append(np.full(len(empty), full[i]))
            bands.append(np.full(len(empty), band[i]))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(bands)


def bucket_shares(rows: DataFrame, percent: int, bucket_bytes: int, least: int = 64, most: int = 1 << 19) -> np.ndarray:
    """Buckets of each band, by the shingles (n) of the rows that are entered in it; a set is in its own band and the one below."""
    classes = rows.where("n > 0").groupBy(F.floor(16 * F.log2(F.col("n").cast("double"))).alias("c")).agg(F.min("n").alias("n"), F.sum("n").alias("sum")).collect()  # 16 rows a doubling
    if not classes:
        return np.ones(1, np.int64)
    edges = band_edges(percent, 1 << max(r["n"] for r in classes).bit_length() + 1)
    load = np.zeros(len(edges), np.float64)
    for r in classes:
        own = int(np.searchsorted(edges, r["n"], "right")) - 1
        load[own] += r["sum"] / 2
        load[max(own - 1, 0)] += r["sum"] / 2
    share = max(min(bucket_bytes / 4, load.sum() / least), load.sum() / most)
    return np.maximum(np.ceil(load / share), 1).astype(np.int64)


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, fp, sketch of each row; fp is null for a text without words and for a null doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column("text")):
                hashes, offsets = shingle_sets(chunk, width)
                ids, n = batch.column("doc_id").slice(chunk.first, len(chunk)), np.diff(offsets)
                fp = fingerprints(hashes, offsets)
                sketch = sized_sketches(hashes, offsets)
                none = (n == 0) | ids.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(fp, mask=none), sketch], names=["doc_id", "n", "fp", "sketch"])

    return docs.mapInArrow(tv.lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, fp long, sketch binary")


def entries(docs: DataFrame, width: int, percent: int, buckets: int | np.ndarray, flush: int = 1 << 19) -> DataFrame:
    """bucket, fps, counts, keys: the keys of the texts of a task, 32 bits each; those of a text lie together, and counts says how many.

    buckets: their number, or that of each band.  With those a text's keys are in the few buckets of its two bands, and its
    fingerprint is sent to no others.  A task holds about `flush` keys, or four a bucket where buckets are many, so that rows
    don't become single keys.
    """
    flush = max(flush, 4 * int(np.sum(buckets)))

    def place(key: np.ndarray, band: np.ndarray) -> np.ndarray:
        if np.ndim(buckets) == 0:
            return (key >> np.uint64(32)).astype(np.int64) % buckets
        band = np.minimum(band, len(buckets) - 1)
        return (np.cumsum(buckets) - buckets)[band] + (key >> np.uint64(32)).astype(np.int64) % buckets[band]

    def pack(keys: list, owners: list, places: list, fps: list) -> pa.RecordBatch:
        key, owner, bucket, fp = np.concatenate(keys), np.concatenate(owners), np.concatenate(places), np.concatenate(fps)
        fp, inverse = np.unique(fp, return_inverse=True)  # copies in a task are entered once
        member = bucket << 24 | inverse[owner]
        order = np.lexsort((key, member))
        key, member = key[order], member[order]
        first = tv.group_starts(key, member)
        key, member = key[first], member[first]
        runs = tv.group_starts(member)
        counts, fp, bucket = np.diff(np.append(runs, len(key))), fp[member[runs] & 0xFFFFFF], member[runs] >> 24
        starts = tv.group_starts(bucket)
        borders, at = np.append(starts, len(runs)), np.append(runs, len(key))
        rows = list(zip(borders, borders[1:], strict=False))
        blobs = [[fp[i:j].tobytes() for i, j in rows], [narrowest(counts[i:j]).tobytes() for i, j in rows], [key[at[i] : at[j]].tobytes() for i, j in rows]]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "fps", "counts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, places, fps, held, texts = [], [], [], [], 0, 0
        for batch in batches:
            for chunk in tv.chunks(batch.column("text")):
                hashes, offsets = shingle_sets(chunk, width)
                missing = batch.column("doc_id").slice(chunk.first, len(chunk)).is_null().to_numpy(zero_copy_only=False)
                key, owner, band = banded_keys(hashes, offsets, percent)
                known = ~missing[owner]
                keys.append(key[known].astype(np.uint32))
                owners.append(owner[known] + texts)
                places.append(place(key[known], band[known]))
                fps.append(fingerprints(hashes, offsets))
                held, texts = held + len(key), texts + len(chunk)
                if held > flush or texts > 8_000_000:
                    yield pack(keys, owners, places, fps)
                    keys, owners, places, fps, held, texts = [], [], [], [], 0, 0
        if held:
            yield pack(keys, owners, places, fps)

    return docs.mapInArrow(tv.lean(run), "bucket int, fps binary, counts binary, keys binary")


def narrowest(counts: np.ndarray) -> np.ndarray:
    return counts.astype("<u2" if counts.max(initial=0) < 1 << 16 else "<u4")


def _bucket_groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Members (fingerprints in rising order) of the keys with several different ones, and their offsets."""
    key, fp = [], []
    for k, c, f in zip(table.column("keys"), table.column("counts"), table.column("fps"), strict=True):
        known = np.frombuffer(f.as_buffer(), np.int64)
        wide = c.as_buffer().size == 4 * len(known)
        key.append(np.frombuffer(k.as_buffer(), np.uint32))
        fp.append(np.repeat(known, np.frombuffer(c.as_buffer(), "<u4" if wide else "<u2")))
    key, fp = np.concatenate(key), np.concatenate(fp)
    order = np.argsort(key)
    key, fp = key[order], fp[order]
    same = key[1:] == key[:-1]
    several = np.zeros(len(key), bool)
    several[1:] |= same
    several[:-1] |= same
    key, fp = key[several], fp[several]
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    first = tv.group_starts(key, fp)
    key, fp = key[first], fp[first]
    starts = tv.group_starts(key)
    sizes = np.diff(np.append(starts, len(key)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    return fp[tv.ragged(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])


def meet(packed: DataFrame, keep=kept) -> DataFrame:
    """hub, fp, shared: each member of a bucket's groups with the groups' hubs, and how many groups they share.

    A group's hub is the member that meets others most often in all groups of all buckets (of equal ones the largest), so the text
    that others are copies of is the hub of nearly all of their groups, and members have few hubs.  A hub is with itself too.
    """

    def run(table: pa.Table) -> pa.Table:
        members, offsets = _bucket_groups(table)
        sizes = np.diff(offsets)
        group = (table.column("bucket")[0].as_py() << 40) + np.repeat(np.arange(len(sizes)), sizes)
        tv.release()
        return pa.table([pa.array(group), pa.array(members), pa.array(np.repeat(sizes - 1, sizes))], names=["g", "fp", "others"])

    members = keep(packed.groupBy("bucket").applyInArrow(run, "g long, fp long, others long"), "members")
    counted = members.join(members.groupBy("fp").agg(F.sum("others").alias("met")), "fp").select("g", "fp", "met")
    hub = F.max(F.struct("met", "fp")).over(Window.partitionBy("g"))["fp"]  # a group has been in one task before
    return counted.withColumn("hub", hub).groupBy("hub", "fp").agg(F.count("*").alias("shared"))


def sketches(column: pa.Array) -> np.ndarray:
    """Sketches of equal lengths as rows of bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1 if rows else 0)


def by_width(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each row the number of its width and its row among those; the sketches of each width."""
    widths, kind = np.unique(pc.binary_length(column).to_numpy(zero_copy_only=False), return_inverse=True)
    row = np.zeros(len(kind), np.int64)
    each = []
    for k in range(len(widths)):
        own = np.flatnonzero(kind == k)
        row[own] = np.arange(len(own))
        each.append(sketches(column.take(pa.array(own))))
    return kind, row, each


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[-1] == width else np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, width), axis=-2)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    width = min(x.shape[-1], y.shape[-1])
    x, y = _folded(x, width), _folded(y, width)
    return np.bitwise_count(np.bitwise_xor(x.view(np.uint64), y.view(np.uint64))).sum(-1, dtype=np.int64)


def fits(na, nb, sa, sb, percent: int):
    """Whether sizes and the lower bound of the symmetric difference that parity sketches give leave the similarity possible."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * _distance(sa, sb) <= (100 - percent) * (na + nb))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, keep=kept, near=fits) -> DataFrame:
    """a, b: the pairs (a, b: fingerprints) whose sets are similar.  sets: fp, n, sketch, doc, a row a fingerprint.
    near(n, n, sketches, sketches, percent) tells which pairs are worth a look at their sets."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("doc").alias("da"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("doc").alias("db"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            (ka, ia, sa), (kb, ib, sb) = by_width(batch.column("sa")), by_width(batch.column("sb"))
            good = np.zeros(len(na), bool)
            for k in np.unique(ka * len(sb) + kb):
                x, y = divmod(int(k), len(sb))
                at = np.flatnonzero((ka == x) & (kb == y))
                good[at] = near(na[at], nb[at], sa[x][ia[at]], sb[y][ib[at]], percent)
            yield batch.select(["a", "b", "da", "db"]).filter(pa.array(good))

    kind = docs.schema["doc_id"].dataType.simpleString()
    close = keep(pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).mapInArrow(tv.lean(look), f"a long, b long, da {kind}, db {kind}"), "join-close")
    needed = keep(close.select(F.explode(F.array(F.struct(F.col("a").alias("fp"), F.col("da").alias("doc")), F.struct(F.col("b").alias("fp"), F.col("db").alias("doc")))).alias("x")).select("x.*").distinct(), "join-needed")
    ids = needed.select(F.col("doc").alias("doc_id")).distinct()
    if needed.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column("text")):
                hashes, offsets = shingle_sets(chunk, width)
                column = pa.array([hashes[i:j].tobytes() for i, j in zip(offsets, offsets[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, offsets)), column], names=["fp", "set"])

    whole = keep(texts.mapInArrow(tv.lean(shingled), "fp long, set binary"), "join-sets")
    if whole.groupBy("fp").count().where("count > 1").limit(1).count():  # by rows that repeat a doc_id; else sets needn't be shuffled for it
        whole = keep(whole.groupBy("fp").agg(F.first("set").alias("set")), "join-each-set")
    x, y = whole.select(F.col("fp").alias("a"), F.col("set").alias("x")), whole.select(F.col("fp").alias("b"), F.col("set").alias("y"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                shared = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                good.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return keep(close.select("a", "b").join(x, "a").join(y, "b").mapInArrow(tv.lean(similar), "a long, b long"), "join-links")


def left_over(groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, keep=kept, near=fits, all_met: bool = False) -> DataFrame:
    """a, b: members of one group (rows hub, fp) that are in different components and whose sketches are near enough.
    all_met: every member has met its hubs, so that a hub and its only member need no look.

    Groups with the same hub are compared as one: they share most of their members, and a pair that agrees in many blocks
    would else be found once for each.  A group's members are dealt into cells of about CELL: by whether they
    are in its largest component, by bands of sizes, of which only neighbours can hold similar sets, and by hash.  Cells
    of the largest component meet only cells of others, so a group of very many copies and a few others takes work in
    proportion to its size.
    """
    if all_met:
        groups = groups.join(groups.groupBy("hub").count().where("count > 2").select("hub"), "hub", "left_semi")
    rows = groups.select(F.col("hub").alias("g"), "fp").join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = keep(rows.join(sets.select("fp", "n"), "fp").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(max(100 / percent, 1.05) + 1e-9)).cast("int")), "join-groups")
    parts = keep(rows.groupBy("g", "root", "band").agg(F.count("*").alias("k")), "join-parts")
    tops = parts.groupBy("g", "root").agg(F.sum("k").alias("k")).groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    tops = keep(tops, "join-tops")
    if not tops.limit(1).count():
        return groups.select(F.col("hub").alias("a"), F.col("fp").alias("b")).limit(0)
    inner = F.col("root") == F.col("top")
    cells = parts.join(tops, "g").groupBy("g", inner.alias("inner"), "band").agg(F.ceil(F.sum("k") / CELL).cast("int").alias("cells"))
    cells = keep(cells.groupBy("g").agg(F.collect_list(F.struct("inner", "band", "cells")).alias("all")), "join-cells")  # two a band of sizes
    rows = rows.join(tops, "g").withColumn("inner", inner).join(cells, "g").join(sets.select("fp", "sketch"), "fp")
    own = F.filter("all", lambda c: (c["inner"] == F.col("inner")) & (c["band"] == F.col("band")))[0]["cells"]
    rows = rows.withColumn("own", F.struct("inner", "band", F.pmod(F.xxhash64("fp"), own).cast("int").alias("i")))
    meets = F.filter("all", lambda c: (F.abs(c["band"] - F.col("band")) <= 1) & ~(c["inner"] & F.col("inner")))
    others = F.flatten(F.transform(meets, lambda c: F.transform(F.sequence(F.lit(0), c["cells"] - 1), lambda i: F.struct(c["inner"].alias("inner"), c["band"].alias("band"), i.alias("i")))))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.xxhash64("own").alias("cell"), "fp", "root", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        fp, root, n, cell = (table.column(c).to_numpy() for c in ("fp", "root", "n", "cell"))
        order = np.argsort(fp)
        fp, root, n, cell = fp[order], root[order], n[order], cell[order]
        kind, row, sketch = by_width(table.column("sketch").combine_chunks().take(pa.array(order)))
        two = table.column("lo")[0] != table.column("hi")[0]
        out = [np.zeros((2, 0), np.int64)]
        for k in range(len(fp) - 1):
            other = np.flatnonzero((root[k + 1 :] != root[k]) & ((cell[k + 1 :] != cell[k]) | (not two))) + k + 1
            other = other[100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k])]
            for w in np.unique(kind[other]):
                those = other[kind[other] == w]
                those = those[near(n[those], n[k], sketch[w][row[those]], sketch[kind[k]][row[k]], percent)]
                out.append(np.stack([np.full(len(those), fp[k]), fp[those]]))
        a, b = np.concatenate(out, 1)
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.groupBy("g", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, bucket_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    docs: doc_id (a whole number), text; other columns are left out.  Words are runs of bytes other than white space,
    with A-Z in lower case; a text of fewer than `width` words is one shingle.  Two documents are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable.  A text without words, a null
    text and a row with a null doc_id are linked with nothing.  Rows that repeat a doc_id stay and share what any of
    them is linked with only through equal sets.  An empty table gives no rows.
    """
    docs = narrow(docs, doc_id="doc_id", text="text")
    found, keep = Shelf(docs.sparkSession, "join"), Shelf(docs.sparkSession, "join-steps")
    with small_batches(docs.sparkSession):  # all steps in Python end in a table before it returns
        rows = found(summaries(docs, width), "documents")
        sets = keep(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "distinct")
        groups = keep(meet(entries(docs, width, percent, bucket_shares(rows, percent, bucket_bytes)), keep), "met")
        return joined(docs, rows, sets, groups, width, percent, found, keep, best=lambda stars: stars.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")))


def _smallest(stars: DataFrame) -> DataFrame:
    return stars.groupBy("b").agg(F.min("a").alias("a"))


def joined(docs: DataFrame, rows: DataFrame, sets: DataFrame, groups: DataFrame, width: int, percent: int, found: Shelf, keep: Shelf, near=fits, best: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id by the links between members of the groups (hub, fp): those of hubs first, then
    those that are left between different components.  rows: doc_id, n, fp; sets: fp, doc, n, sketch; found holds what the
    result reads, keep what it doesn't.  best gives a pair (a, b) for each member b of pairs of hubs and members: twice a member
    meets that hub of those in other components, and what is left is compared by cells, hubs of one member too.
    Without best, each first meets its smallest hub, then all others that are in different components."""
    stars = groups.where("hub <> fp").withColumnsRenamed({"hub": "a", "fp": "b"})
    links = verified((best or _smallest)(stars), sets, docs, width, percent, keep, near)
    labels = keep(components(links, keep), "labels")
    left, right = (labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    stars = stars.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")
    stars = best(stars) if best else stars.select("a", "b")
    links = links.unionByName(verified(keep(stars, "other-hubs"), sets, docs, width, percent, keep, near))
    labels = keep(components(links, keep), "labels")
    more = keep(left_over(groups, labels, sets, percent, keep, near, all_met=best is None), "more")
    if more.limit(1).count():
        links = links.unionByName(verified(more, sets, docs, width, percent, keep, near))
        labels = keep(components(links, keep), "labels")
    known = sets.select("fp", "doc").join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = keep(known, "roots")
    lowest = keep(known.groupBy("root").agg(F.min("doc").alias("component_id")), "lowest")
    named = found(known.join(lowest, "root").select("fp", "component_id"), "named")
    keep.clear()
    alone = rows.where("fp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("fp is not null").select("doc_id", "n", "fp").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
