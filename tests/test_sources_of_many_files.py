import os
import random

import pytest
from pyspark.sql import functions as F

from quernstone.sources import files, ordered, snapshots


def listing(root):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, found in os.walk(root) for f in found}


def test_a_change_leaves_other_buckets_files_alone(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}", None if i % 3 else "x") for i in range(200)], "id long, v string, w string")
    snapshots.create(rows, root, ["id"], 8)
    before = listing(root)
    bucket = lambda df: {r.id: r.b for r in df.select("id", snapshots.bucket_of(["id"], 8).alias("b")).collect()}
    changes = spark.createDataFrame([(5, "new", None), (1000, "more", "y")], "id long, v string, w string")
    touched = set(bucket(changes).values())
    assert snapshots.change(spark, root, 0, changes, rows.schema, ["id"], 8) == 1
    after = listing(root)
    assert all(after[f] == t for f, t in before.items())
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(after) - set(before) if "bucket=" in f} == touched
    got = {r.id: (r.v, r.w, r.written) for r in snapshots.read(spark, root, 1, rows.schema).collect()}
    where = bucket(rows.select("id").unionByName(changes.select("id")))
    want = {i: (f"v{i}", None if i % 3 else "x") for i in range(200)} | {5: ("new", None), 1000: ("more", "y")}
    assert got == {i: (*v, int(where[i] in touched)) for i, v in want.items()}
    old = {r.id: r.v for r in snapshots.read(spark, root, 0, rows.schema).collect()}
    assert old == {i: f"v{i}" for i in range(200)}


def test_snapshots_of_an_empty_table(spark, tmp_path):
    root, none = str(tmp_path / "t"), spark.createDataFrame([], "id long, v string")
    snapshots.create(none, root, ["id"], 4)
    assert snapshots.read(spark, root, 0, none.schema).count() == 0
    assert snapshots.change(spark, root, 0, spark.createDataFrame([(1, "a")], none.schema), none.schema, ["id"], 4) == 1
    assert snapshots.change(spark, root, 1, none, none.schema, ["id"], 4) == 2
    assert [(r.id, r.v, r.written) for r in snapshots.read(spark, root, 2, none.schema).collect()] == [(1, "a", 1)]


@pytest.mark.parametrize("size", ["64m", "4k"])
def test_lines_keep_their_order_over_files(spark, tmp_path, size):
    """With small splits a file is read by several tasks."""
    rng = random.Random(1)
    names = [f"{rng.randrange(10**6):06d} {'é' * rng.randrange(30)}" for _ in range(5000)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int").repartition(7)
    at = str(tmp_path / "lines")
    ordered.write_lines(df, "name", ["name", F.col("i").desc()], at, 6)
    assert 1 < sum(f.startswith("part-") for f in os.listdir(at)) <= 6
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = sorted((r.ordinal, r.line) for r in ordered.read_lines(spark, at).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == list(enumerate(sorted(names), 1))


def test_no_lines(spark, tmp_path):
    at = str(tmp_path / "none")
    ordered.write_lines(spark.createDataFrame([], "x string"), "x", ["x"], at)
    assert ordered.read_lines(spark, at).count() == 0


def test_a_walk_never_enters_excluded_folders(spark, tmp_path, monkeypatch):
    """Folders that the rules leave out are gone before their turn to be listed, which would fail for them."""
    root = tmp_path / "root"
    for path in ("a/x.py", "a/b/y.PY", "a/b/z.txt", "skip/deep/er/q.py", "a/old-skip/r.py", "top.py", "empty/.keep", "é ü/n.py"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x")
    os.symlink(root / "a", root / "link")
    rules = {"exact": ("SKIP",), "words": ("skip",), "include": (".py",)}
    listed = []
    inner = files._entries
    monkeypatch.setattr(files, "_entries", lambda s, df: listed.extend(r.folder for r in df.collect()) or inner(s, df))
    got = files.walk(spark, str(root), **rules)
    assert {(r.path, r.is_dir) for r in got.collect()} == {("a", True), ("a/b", True), ("empty", True), ("é ü", True), ("a/x.py", False), ("a/b/y.PY", False), ("top.py", False), ("é ü/n.py", False)}
    assert sorted(os.path.relpath(f, root) for f in listed) == [".", "a", "a/b", "empty", "é ü"]
    assert {r.path for r in files.walk(spark, f"file://{root}", folders=("a",), **rules).where("not is_dir").collect()} == {"a/x.py", "top.py"}
    assert files.walk(spark, str(tmp_path / "none")).count() == 0
