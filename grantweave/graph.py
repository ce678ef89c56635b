"""``AccessGraph``: the graph's tables and the questions an explorer asks of them.

Each method returns a DataFrame, so answers can be filtered, joined, sorted and exported like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import explore, permissions, tags, traverse
from .sinks import export
from .sources import exports


class AccessGraph:
    """nodes, edges and effective permissions (see ``schemas``); ids are the nodes' ids."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, effective_permissions: DataFrame):
        self.nodes, self.edges, self.permissions = nodes, edges, effective_permissions
        self.spark: SparkSession = nodes.sparkSession

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AccessGraph:
        t = exports.snapshot(spark, path)
        return cls(t["nodes"], t["edges"], t["effective_permissions"])

    def save(self, path: str, identity_map: DataFrame) -> None:
        export.snapshot({"nodes": self.nodes, "edges": self.edges, "effective_permissions": self.permissions, "identity_map": identity_map}, path)

    def list(self, *types: str) -> DataFrame:
        return explore.sorted_nodes(explore.summaries(explore.listed(self.nodes, *types)))

    def node(self, node_id: str, node_type: str | None = None) -> DataFrame:
        return explore.by_id(self.nodes, node_id, node_type)

    def _arcs(self, src: str, dst: str, *types: str) -> DataFrame:
        """(src, dst) by id, between nodes of two types."""
        return self.edges.where(F.col("edge_type").isin(*types) & (F.col("src_type") == src) & (F.col("dst_type") == dst)).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()

    def _from(self, node_id: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(node_id).alias("source"))

    # users and groups

    def _membership(self, kind: str) -> DataFrame:
        """Arcs upwards; users and groups are told apart by a mark, since they may share an id."""
        mark = lambda t, c: F.concat(F.lit(t + ":"), c)
        users = self._arcs("user", "group", "member_of").select(mark("user", "src").alias("src"), mark("group", "dst").alias("dst"))
        up = users.union(self._arcs("group", "group", "member_of").select(mark("group", "src").alias("src"), mark("group", "dst").alias("dst")))
        return up if kind == "up" else up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    @staticmethod
    def _unmarked(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumns({c: F.regexp_replace(c, "^(user|group):", "") for c in columns})

    def direct_groups(self, node_id: str, node_type: str = "user") -> DataFrame:
        return self._unmarked(traverse.hop(self._membership("up"), self._from(f"{node_type}:{node_id}")).select("node"), "node")

    def inherited_groups(self, node_id: str, node_type: str = "user") -> DataFrame:
        return traverse.paths(self._membership("up"), self._from(f"{node_type}:{node_id}"), min_depth=2).select("node", "path")

    def direct_members(self, group_id: str, node_type: str) -> DataFrame:
        found = traverse.hop(self._membership("down"), self._from(f"group:{group_id}")).where(F.startswith("node", F.lit(node_type + ":")))
        return self._unmarked(found.select("node"), "node")

    def all_members(self, group_id: str) -> DataFrame:
        return traverse.paths(self._membership("down"), self._from(f"group:{group_id}")).where(F.startswith("node", F.lit("user:"))).select("node", "path")

    # assets

    def hierarchy(self, asset_id: str, up: bool = True) -> DataFrame:
        return traverse.paths(self._arcs("asset", "asset", "child_of" if up else "parent_of"), self._from(asset_id)).select("node", "path")

    def lineage(self, asset_id: str, up: bool = True) -> DataFrame:
        return traverse.paths(self._arcs("asset", "asset", "derived_from" if up else "derived_to"), self._from(asset_id)).select("node", "path")

    def assets_of_user(self, user_id: str) -> DataFrame:
        return permissions.access(self.permissions.where(F.col("user_id") == user_id)).select("asset_id", "privileges")

    def users_of_asset(self, asset_id: str, downstream: bool = False) -> DataFrame:
        one = self._from(asset_id)
        if downstream:
            return permissions.users_downstream(self.permissions, self._arcs("asset", "asset", "derived_to"), one)
        return permissions.users_of(self.permissions, one.select(F.col("source").alias("asset_id")))

    # tags

    def _tag_tables(self) -> tuple[DataFrame, ...]:
        pair = lambda kind: self._arcs("tag", "asset", kind).select(F.col("src").alias("tag"), F.col("dst").alias("asset"))
        flags = self.nodes.where("node_type = 'tag'").select(F.col("node_id").alias("tag"), "pass_through_hierarchy", "pass_through_lineage")
        return flags, pair("applied_to"), pair("removed_from"), self._arcs("asset", "asset", "parent_of"), self._arcs("asset", "asset", "derived_to")

    def tags_of_asset(self, asset_id: str) -> DataFrame:
        one = self._from(asset_id).withColumnRenamed("source", "asset")
        return tags.tags_for_assets(*tags.towards(one, *self._tag_tables())).where(F.col("asset") == asset_id).select("tag", "via")

    def assets_of_tag(self, tag_id: str) -> DataFrame:
        return tags.assets_for_tags(*tags.of_tag(tag_id, *self._tag_tables())).select("asset", "via")

    def tag_paths(self, tag_id: str) -> DataFrame:
        return tags.tag_paths(*tags.of_tag(tag_id, *self._tag_tables())).select("asset", "path")

    def users_of_tag(self, tag_id: str) -> DataFrame:
        return permissions.users_for_tags(self.permissions, tags.all_tags(*tags.of_tag(tag_id, *self._tag_tables()))).select("user_id")

    def tags_of_user(self, user_id: str) -> DataFrame:
        mine = self.permissions.where(F.col("user_id") == user_id)
        own = permissions.access(mine).select(F.col("asset_id").alias("asset"))
        return permissions.tags_of_users(mine, tags.all_tags(*tags.towards(own, *self._tag_tables()))).select("tag", "assets")

    # drawings

    def subgraph(self, node_type: str, node_id: str, max_depth: int) -> DataFrame:
        return traverse.subgraph(traverse.arcs(self.edges), f"{node_type}:{node_id}", max_depth)

    def drawing(self, node_type: str, node_id: str, max_depth: int) -> DataFrame:
        return export.dot(self.subgraph(node_type, node_id, max_depth))
