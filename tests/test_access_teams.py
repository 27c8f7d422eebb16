"""Members told by teams give what a table of members gives, and make no row for a member on the way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.operators import access
from quernstone.plans import access as plans

def _now():
    return F.lit("2024-01-01").cast("timestamp")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def world(spark):
    users = spark.createDataFrame([(u, u % 3) for u in range(1, 9)] + [(20, None), (None, 1)], "user_id long, team long")
    groups = spark.createDataFrame([(10, 0), (11, 1), (12, 1), (12, 2), (13, 5), (None, 0), (14, None)], "group_id long, team long")
    teams = access.Teams(users, groups)
    files = spark.createDataFrame([(1, 1, 30, "private"), (2, 2, 31, "public"), (3, 3, None, "private")], "id long, owner_id long, parent_folder_id long, visibility string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    folders = spark.createDataFrame([(30, 4, "private"), (31, 5, "public")], "id long, owner_id long, visibility string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    grants = [(1, "file", 11, "group", "read"), (1, "file", 12, "group", "admin"), (1, "file", 5, "user", "write"), (2, "file", 10, "group", "write"), (3, "file", 12, "group", "read"), (3, "file", 14, "group", "admin")]
    grants += [(30, "folder", 10, "group", "write"), (30, "folder", 7, "user", "read"), (31, "folder", 12, "group", "admin"), (31, "folder", 20, "user", "write"), (30, "folder", 13, "group", "admin")]
    permissions = spark.createDataFrame(grants, "resource_id long, resource_type string, grantee_id long, grantee_type string, permission_level string").withColumn("expires_at", F.lit(None).cast("timestamp"))
    return teams, files, folders, permissions


@pytest.mark.parametrize("mode", ["max", "tiered"])
def test_levels(spark, world, mode):
    teams, files, folders, permissions = world
    asked = files.select("id").crossJoin(spark.range(0, 22).select(F.col("id").alias("user_id")))
    got, want = (access.effective(asked, files, folders, permissions, m, _now(), mode) for m in (teams, teams.members()))
    assert _rows(got) == _rows(want)
    assert {r.level for r in got.collect()} == {None, "read", "write", "admin"}


def test_members_grants_groups_and_counts(spark, world):
    teams, _, _, permissions = world
    flat = teams.members()
    assert _rows(flat) == sorted((g, u) for g, ks in {10: (0,), 11: (1,), 12: (1, 2)}.items() for u in range(1, 9) if u % 3 in ks)
    assert _rows(access.group_grants(permissions, teams, _now())) == _rows(access.group_grants(permissions, flat, _now()))
    owned = spark.createDataFrame([(1, 11), (1, 10), (3, 10), (None, 14), (9, None), (9, None)], "owner_id long, id long")
    assert _rows(access.groups_of(owned, teams)) == _rows(access.groups_of(owned, flat))
    added = spark.createDataFrame([(10, 3), (11, 3), (11, 3), (13, 30)], "group_id long, user_id long")
    want = flat.unionByName(added).distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    assert _rows(access.group_counts(teams, added)) == _rows(want)


def test_dealt_is_a_join_also_with_long_lists_and_equal_rows(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None), (5, 7)], "id long, k long")
    others = spark.range(3 * access.PIECE).select((F.col("id") % 2 * 7).alias("k"), (F.col("id") % 1000).alias("x")).unionByName(spark.createDataFrame([(None, 5), (0, None)], "k long, x long"))
    assert _rows(access.dealt(rows, others, "k")) == _rows(rows.join(others, "k").select("id", "k", "x"))


def test_rows_of_one_key_are_dealt_in_several_tasks_and_others_come_out_again_and_again(spark):
    rows = spark.range(8 * access.PIECE).select("id", F.lit(1).alias("k"))
    others = spark.range(3 * access.PIECE).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    got = access.dealt(rows, others, "k").select("id", "x", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    assert got.select("p").distinct().count() > 1
    first = [r.x for r in got.orderBy("at").limit(3 * access.PIECE).collect()]
    assert len(set(first)) < 2 * access.PIECE  # one list of others for several rows, not all others for one row
    assert got.agg(F.count("*"), F.count_distinct("id"), F.count_distinct("x")).first() == (24 * access.PIECE**2, 8 * access.PIECE, 3 * access.PIECE)


@pytest.mark.parametrize("name", ["jn01_group_grants", "jn02_folder_grants", "jn05_groups_of_user", "dm09_group_members", "ag01_effective_permission", "ag02_tiered_permission", "dm04_managed_writes", "dm08_required_write"])
def test_no_join_has_a_row_for_a_member(spark, name):
    """No plan joins customers with suppliers by their digits, and what is read from lists is not grouped again."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey#" not in plan or not any("Join Inner" in line and "% 100" in line and "c_custkey" in line and "s_suppkey" in line for line in plan.splitlines())
    tail = plan[: plan.index("Generate inline")] if "Generate inline" in plan else ""
    assert "Aggregate" not in tail
