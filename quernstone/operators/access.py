"""Who may do what with which file: effective permissions, visible rows, share links and groups.

Tables: files (id, owner_id, path, parent_folder_id, visibility, deleted_at, ...), folders (id, owner_id, path,
visibility, deleted_at), permissions (resource_id, resource_type, grantee_id, grantee_type, permission_level,
expires_at), members (group_id, user_id, or `Teams`).  Times are compared with `as_of`, never with the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Ranks of levels.
LEVELS = ("read", "write", "admin")
#: Rows that are dealt to all others of a key lie in lists of about so many; a key's lists go to so many tasks.
PIECE, SPREAD = 512, 8


@dataclass(frozen=True)
class Teams:
    """Members told by teams: a user is in all groups of the user's team.

    users: user_id, team, each user once; groups: group_id, team, each pair once; nulls are in nothing.  With large groups
    these tables are far smaller than one of members, which has users times groups of each team.
    """

    users: DataFrame
    groups: DataFrame

    def members(self) -> DataFrame:
        """group_id, user_id, each pair once; a stream of rows that nothing shuffles."""
        return dealt(self.groups.where("group_id is not null"), self.users.where("user_id is not null"), "team").select("group_id", "user_id")

    def sizes(self) -> DataFrame:
        """user_id, n: the number of a user's groups, of users with any."""
        n = self.groups.where("group_id is not null and team is not null").groupBy("team").agg(F.count("*").alias("n"))
        return self.users.where("user_id is not null").join(n, "team").select("user_id", "n")

    def has(self, pairs: DataFrame) -> DataFrame:
        """The rows of pairs (user_id, group_id, ...) that are memberships."""
        return pairs.join(self.users.select("user_id", F.col("team").alias("_team")), "user_id").join(self.groups.select("group_id", F.col("team").alias("_team")), ["group_id", "_team"], "left_semi").select(*pairs.columns)


def dealt(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows joined with others (the key and other columns) by the key.  Both lie in lists of about PIECE, so the join makes a row a pair
    of lists, and what comes out is read from the lists: it is neither shuffled nor kept, however many rows it has.  A list of others
    comes out once for each row of a list, again and again, which packs well.  A key's lists of rows go to SPREAD tasks, as a
    few bytes may give very many rows: by their number, not by their bytes, which Spark would put together in a few tasks."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    mine = _lists(rows, key, "_mine").withColumn("_spread", F.pmod("_part", F.lit(SPREAD)).cast("int")).drop("_part")
    theirs = _lists(others, key, "_all").drop("_part").withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    pairs = mine.repartition(tasks, key, "_spread").join(theirs.repartition(tasks, key, "_spread"), [key, "_spread"])
    return pairs.select(key, "_all", F.inline("_mine")).select(*rows.columns, F.inline("_all"))


def _lists(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, _part and the other columns of its rows in lists of about PIECE."""
    rest = [c for c in rows.columns if c != key]
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / PIECE).alias("_parts"))
    return rows.join(sizes, key).groupBy(key, F.pmod(F.xxhash64(*rest), "_parts").alias("_part")).agg(F.collect_list(F.struct(*rest)).alias(name))


def rank(level: Column) -> Column:
    return F.when(level == "admin", 3).when(level == "write", 2).when(level == "read", 1).otherwise(0)


def level_of(r: Column) -> Column:
    return F.when(r == 3, "admin").when(r == 2, "write").when(r == 1, "read")


def higher(a: Column, b: Column) -> Column:
    return F.when(rank(b) > rank(a), b).otherwise(a)


def live(df: DataFrame) -> DataFrame:
    """Rows that no soft delete marks."""
    return df.where(F.col("deleted_at").isNull())


def unexpired(expires: Column, as_of: Column) -> Column:
    return expires.isNull() | (expires > as_of)


def granted(permissions: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """resource_id, resource_type, user_id, rank, by_group: live grants, those to groups dealt to their members."""
    now = permissions.where(unexpired(F.col("expires_at"), as_of)).select("resource_id", "resource_type", "grantee_id", "grantee_type", rank(F.col("permission_level")).alias("rank"))
    direct = now.where("grantee_type = 'user'").select("resource_id", "resource_type", F.col("grantee_id").alias("user_id"), "rank", F.lit(False).alias("by_group"))
    grouped = now.where("grantee_type = 'group'").join(members.select(F.col("group_id").alias("grantee_id"), "user_id"), "grantee_id")
    return direct.unionByName(grouped.select("resource_id", "resource_type", "user_id", "rank", F.lit(True).alias("by_group")))


def group_grants(permissions: DataFrame, members: DataFrame | Teams, as_of: Column) -> DataFrame:
    """resource_id, resource_type, user_id, rank: the highest live grant to a group of a user, each resource and user once.

    By teams, grants are compared before they are dealt to users, so only the grants are shuffled.
    """
    if isinstance(members, DataFrame):
        return granted(permissions, members, as_of).where("by_group").groupBy("resource_id", "resource_type", "user_id").agg(F.max("rank").alias("rank"))
    best = _to_teams(permissions, members, as_of)
    return dealt(best, members.users.where("user_id is not null"), "team").select("resource_id", "resource_type", "user_id", "rank")


def _to_teams(permissions: DataFrame, members: Teams, as_of: Column) -> DataFrame:
    """resource_id, resource_type, team, rank: the highest live grant to a group of a team."""
    now = permissions.where(unexpired(F.col("expires_at"), as_of)).where("grantee_type = 'group'")
    met = now.join(members.groups.select(F.col("group_id").alias("grantee_id"), "team"), "grantee_id")
    return met.groupBy("resource_id", "resource_type", "team").agg(F.max(rank(F.col("permission_level"))).alias("rank"))


def _on_folders(f: DataFrame, permissions: DataFrame, members: DataFrame | Teams, as_of: Column) -> DataFrame:
    """f with in_folder: the highest rank that grants of a row's folder give its user, or null."""
    permissions = permissions.where("resource_type = 'folder'")
    if isinstance(members, DataFrame):
        best = granted(permissions, members, as_of).groupBy(F.col("resource_id").alias("parent_folder_id"), "user_id").agg(F.max("rank").alias("in_folder"))
        return f.join(best, ["parent_folder_id", "user_id"], "left")
    direct = granted(permissions.where("grantee_type = 'user'"), members.users.limit(0).select(F.col("team").alias("group_id"), "user_id"), as_of)
    direct = direct.groupBy(F.col("resource_id").alias("parent_folder_id"), "user_id").agg(F.max("rank").alias("_direct"))
    grouped = _to_teams(permissions, members, as_of).select(F.col("resource_id").alias("parent_folder_id"), "team", F.col("rank").alias("_grouped"))
    rows = f.join(direct, ["parent_folder_id", "user_id"], "left").join(members.users, "user_id", "left").join(grouped, ["parent_folder_id", "team"], "left")
    return rows.select(*f.columns, F.greatest("_direct", "_grouped").alias("in_folder"))


def effective(requests: DataFrame, files: DataFrame, folders: DataFrame, permissions: DataFrame, members: DataFrame | Teams, as_of: Column, mode: str = "max") -> DataFrame:
    """requests (id, user_id, each pair once) with level: what a user may do with a file, null for nothing.

    max: the owner is admin; else the highest of public (read), direct and group grants, and what the folder itself
    gives (its owner admin, public read, grants).  tiered: the first of owner, public, direct, group, folder grants.

    A request meets the grants of its file, of which there are few, and a grant to a group counts if the pair of user and
    group is a membership; so no request is multiplied by the groups of its user.  Grants of folders are dealt to members
    once for a folder and user, whatever is asked, or to teams if members are told so: then no row is made for a member.
    """
    asked = requests.select("id", "user_id").distinct()
    f = asked.join(live(files).select("id", "owner_id", "visibility", "parent_folder_id"), "id")
    now = permissions.where(unexpired(F.col("expires_at"), as_of)).select("resource_id", "resource_type", "grantee_id", "grantee_type", rank(F.col("permission_level")).alias("rank"))
    on_file = now.where("resource_type = 'file'").select(F.col("resource_id").alias("id"), "grantee_id", "grantee_type", "rank")
    direct, by_group = F.col("grantee_type") == "user", F.col("grantee_type") == "group"
    met = f.select("id", "user_id").join(on_file, "id").where(by_group | (direct & (F.col("grantee_id") == F.col("user_id"))))
    met = met.withColumn("group_id", F.when(by_group, F.col("grantee_id")))
    if isinstance(members, Teams):
        met = met.where(direct).unionByName(members.has(met.where(by_group)))
    else:
        inside = members.select("user_id", "group_id").distinct().withColumn("_in", F.lit(True))
        met = met.join(inside, ["user_id", "group_id"], "left").where(direct | F.col("_in"))
    on_file = met.groupBy("id", "user_id").agg(F.max(F.when(direct, F.col("rank"))).alias("direct"), F.max(F.when(by_group, F.col("rank"))).alias("grouped"))
    rows = _on_folders(f.join(on_file, ["id", "user_id"], "left"), permissions, members, as_of)
    owner, public, folder = F.col("owner_id") == F.col("user_id"), F.col("visibility") == "public", F.col("in_folder")
    if mode == "max":
        d = live(folders).select(F.col("id").alias("parent_folder_id"), F.col("owner_id").alias("folder_owner"), F.col("visibility").alias("folder_visibility"))
        rows = rows.join(d.withColumn("_live", F.lit(True)), "parent_folder_id", "left")
        own = F.when(F.col("folder_owner") == F.col("user_id"), 3).when(F.col("folder_visibility") == "public", 1)
        best = F.greatest(F.when(owner, 3), F.when(public, 1), F.col("direct"), F.col("grouped"), F.when(F.col("_live"), F.greatest(own, folder)))
    else:
        best = F.when(owner, 3).when(public, 1).otherwise(F.coalesce("direct", "grouped", folder))
    return asked.join(rows.select("id", "user_id", level_of(best).alias("level")), ["id", "user_id"], "left")


def file_tree(files: DataFrame, levels: DataFrame) -> DataFrame:
    """user_id, tree: a JSON list of the files that a user may at least read, by path.  levels: what `effective` gives.

    A user's list is one row, so this is for answers to users; tables of all rows stay as `levels` has them.
    """
    rows = live(files).join(levels.where("level is not null"), "id").select("user_id", F.struct("path", "id", F.col("level").alias("effective_permission")).alias("x"))
    return rows.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("tree"))


def secure_view(files: DataFrame, permissions: DataFrame, members: DataFrame, user, as_of: Column, write: bool = False) -> DataFrame:
    """Files that the row policies let a user see; write: change.

    See: owned, public, granted directly or by group, or in a folder granted to the user.  Change: owned, or granted
    with write or admin.
    """
    g = granted(permissions, members, as_of).where(F.col("user_id") == F.lit(user))
    g = g.where("rank >= 2") if write else g
    direct = g.where("resource_type = 'file'").select(F.col("resource_id").alias("id")).distinct()
    marked = files.join(direct.withColumn("_granted", F.lit(True)), "id", "left")
    keep = (F.col("owner_id") == F.lit(user)) | F.col("_granted")
    if not write:
        folder = g.where("resource_type = 'folder' and not by_group").select(F.col("resource_id").alias("parent_folder_id")).distinct()
        marked = marked.join(folder.withColumn("_folder", F.lit(True)), "parent_folder_id", "left")
        keep = keep | F.col("_folder") | (F.col("visibility") == "public")
    return marked.where(keep).select(*files.columns)


def groups_of(groups: DataFrame, members: DataFrame | Teams) -> DataFrame:
    """user_id, group_id: groups that a user owns or is in, each once."""
    owned = groups.select(F.col("owner_id").alias("user_id"), F.col("id").alias("group_id"))
    if isinstance(members, DataFrame):
        return owned.unionByName(members.select("user_id", "group_id")).distinct()
    return members.members().select("user_id", "group_id").unionByName(_fresh(owned, members))


def _fresh(pairs: DataFrame, members: Teams) -> DataFrame:
    """user_id, group_id: the pairs that aren't memberships, each once."""
    pairs = pairs.select("user_id", "group_id").distinct()
    return pairs.join(members.has(pairs), ["user_id", "group_id"], "left_anti")


def group_counts(members: Teams, added: DataFrame) -> DataFrame:
    """user_id, n: how many groups a user is in after the pairs (user_id, group_id) of added have come in; users without any have no row."""
    more = _fresh(added, members).groupBy("user_id").agg(F.count("*").alias("n"))
    return members.sizes().unionByName(more).groupBy("user_id").agg(F.sum("n").alias("n"))


def require(levels: DataFrame, level: str) -> DataFrame:
    """Rows of `levels` at or above a level."""
    return levels.where(rank(F.col("level")) >= 1 + LEVELS.index(level))


def grant(permissions: DataFrame, changes: DataFrame) -> DataFrame:
    """The permissions after `changes` (same columns): one row a resource and grantee, the change's where it has one."""
    keys = ["resource_id", "resource_type", "grantee_id", "grantee_type"]
    return permissions.join(changes, keys, "left_anti").unionByName(changes)


def revoke(permissions: DataFrame, changes: DataFrame) -> DataFrame:
    return permissions.join(changes, ["resource_id", "resource_type", "grantee_id", "grantee_type"], "left_anti")


def used_links(links: DataFrame, uses: DataFrame) -> DataFrame:
    """share_token, use_id, used_at, ok, use_number: uses in their order, good while the link is active, unexpired and
    below max_uses (null: no limit)."""
    order = W.Window.partitionBy("share_token").orderBy("used_at", "use_id")
    rows = uses.join(links.select("share_token", "is_active", "expires_at", "max_uses"), "share_token", "left")
    able = F.coalesce(F.col("is_active"), F.lit(False)) & unexpired(F.col("expires_at"), F.col("used_at"))
    rows = rows.withColumn("_able", able).withColumn("_n", F.sum(F.col("_able").cast("int")).over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    ok = F.col("_able") & (F.col("max_uses").isNull() | (F.col("_n") <= F.col("max_uses")))
    return rows.select("share_token", "use_id", "used_at", ok.alias("ok"), F.when(ok, F.col("_n")).cast("int").alias("use_number"))


def broken_constraints(df: DataFrame, unique: tuple[str, ...], allowed: dict[str, tuple] | None = None) -> DataFrame:
    """constraint, n: how many rows break the key or hold a value that isn't allowed; no row: none."""
    rows = df.groupBy(*unique).count().where("count > 1").agg(F.lit("unique(" + ", ".join(unique) + ")").alias("constraint"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n"))
    for c, values in (allowed or {}).items():
        rows = rows.unionByName(df.where(~F.col(c).isin(*values)).agg(F.lit(f"check({c})").alias("constraint"), F.count("*").alias("n")))
    return rows.where("n > 0")
