"""Effective permissions: merging, and who can reach what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .traverse import reach

KEY = ["user_id", "asset_id", "privilege"]


def merge(permissions: DataFrame) -> DataFrame:
    """One row per (user, asset, privilege). Rows apply in order of ``seq``: a new mode replaces mode and reasons, the
    same mode adds its reasons. So the result is the last mode with the reasons of the last run of rows in that mode."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    marked = permissions.withColumn("turn", F.when(F.lag("mode").over(order).eqNullSafe(F.col("mode")), 0).otherwise(1))
    run = marked.withColumn("run", F.sum("turn").over(order))
    grouped = run.groupBy(*KEY, "run").agg(
        F.first("mode").alias("mode"), F.first("mode_detail").alias("mode_detail"), F.max("seq").alias("seq"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "reasons"))), lambda x: x["reasons"])).alias("reasons"),
    )
    last = grouped.groupBy(*KEY).agg(F.max_by(F.struct("mode", "mode_detail", "reasons", "seq"), "run").alias("m"))
    return last.select(*KEY, "m.mode", "m.mode_detail", "m.reasons", "m.seq")


def last_write(permissions: DataFrame) -> DataFrame:
    """One row per key, the one with the largest seq."""
    return permissions.groupBy(*KEY).agg(F.max_by(F.struct("mode", "mode_detail", "reasons", "seq"), "seq").alias("m")).select(*KEY, "m.*")


def by_id(named: DataFrame, users: DataFrame, assets: DataFrame) -> DataFrame:
    """Permissions by name turned into permissions by id: both names must be known (inner joins on (name, node_id))."""
    u = users.select(F.col("name").alias("user"), F.col("node_id").alias("user_id"))
    a = assets.select(F.col("name").alias("asset"), F.col("node_id").alias("asset_id"))
    return named.join(u, "user").join(a, "asset").drop("user", "asset")


def allowed(permissions: DataFrame) -> DataFrame:
    """Only what is allowed; users and assets without any such row are gone by themselves."""
    return permissions.where(F.col("mode") == "allow")


def access(permissions: DataFrame) -> DataFrame:
    """(user_id, asset_id, privileges): what each user may do with each asset."""
    return allowed(permissions).groupBy("user_id", "asset_id").agg(F.sort_array(F.collect_set("privilege")).alias("privileges"))


def users_of(permissions: DataFrame, assets: DataFrame) -> DataFrame:
    """(user_id, assets): users with access to any of the given assets (column asset_id), and to which."""
    mine = allowed(permissions).join(assets.select("asset_id").distinct(), "asset_id", "left_semi")
    return mine.groupBy("user_id").agg(F.sort_array(F.collect_set("asset_id")).alias("assets"))


def users_downstream(permissions: DataFrame, lineage: DataFrame, asset: DataFrame) -> DataFrame:
    """Users with access to the given assets (column source) or to anything derived from them, and to which."""
    below = reach(lineage, asset).select(F.col("node").alias("asset_id")).union(asset.select("source")).distinct()
    return users_of(permissions, below)


def users_for_tags(permissions: DataFrame, tagged: DataFrame) -> DataFrame:
    """(tag, user_id) for assets tagged in any way: (asset, tag)."""
    mine = allowed(permissions).select("user_id", F.col("asset_id").alias("asset")).distinct()
    return tagged.select("tag", "asset").distinct().join(mine, "asset").select("tag", "user_id").distinct()


def tags_of_users(permissions: DataFrame, tagged: DataFrame) -> DataFrame:
    """(user_id, tag, assets): the tags a user meets, with the assets that bear them."""
    mine = allowed(permissions).select("user_id", F.col("asset_id").alias("asset")).distinct()
    found = mine.join(tagged.select("tag", "asset").distinct(), "asset")
    return found.groupBy("user_id", "tag").agg(F.sort_array(F.collect_set("asset")).alias("assets"))


def union_sets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Maps of sets merged: (key, value) rows of both, one sorted set per key."""
    return left.select(key, value).unionByName(right.select(key, value)).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(value))
