"""Desired and observed state of policies, groups and memberships, read from configuration or from the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import combine
from .traverse import reach


def neighbours(edges: DataFrame, edge_type: str, *kinds: str) -> DataFrame:
    """(src_id, dst_type, dst_id) along one edge type, to nodes of the given kinds."""
    found = edges.where(F.col("edge_type") == edge_type)
    return (found.where(F.col("dst_type").isin(*kinds)) if kinds else found).select("src_id", "dst_type", "dst_id").distinct()


def observed_policies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(asset, agent_type, agent, privileges, and metadata if nodes have it): each policy over each of its agents and assets. Privileges
    of several policies are united; their metadata is merged key by key, of unlike values the first policy's (by id)."""
    known = ["metadata"] if "metadata" in nodes.columns else []
    policies = nodes.where("node_type = 'policy'").select(F.col("node_id").alias("src_id"), "privileges", *known)
    agents = neighbours(edges.where("src_type = 'policy'"), "granted_to", "user", "group").select("src_id", F.col("dst_type").alias("agent_type"), F.col("dst_id").alias("agent"))
    assets = neighbours(edges.where("src_type = 'policy'"), "governs", "asset").select("src_id", F.col("dst_id").alias("asset"))
    return combine(policies.join(agents, "src_id").join(assets, "src_id").withColumn("seq", F.col("src_id")))


def observed_default_policies(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defaults with root, agent, metadata if nodes have it, and connector_managed; violations): a default policy must have exactly one root. Only
    default policies that their connector keeps are in the graph."""
    mine = edges.where("src_type = 'default_policy'")
    roots = neighbours(mine, "provided_default_for_children", "asset").select("src_id", F.col("dst_id").alias("root"))
    known = ["metadata"] if "metadata" in nodes.columns else []
    p = nodes.where("node_type = 'default_policy'").select(F.col("node_id").alias("src_id"), F.col("matching_path").alias("path"), "target_type", "privileges", *known)
    counted = p.select("src_id").join(roots, "src_id", "left").groupBy("src_id").agg(F.count("root").alias("roots"), F.min("root").alias("root"))
    agents = neighbours(mine, "granted_to", "user", "group").select("src_id", F.col("dst_type").alias("agent_type"), F.col("dst_id").alias("agent"))
    found = p.join(counted.where("roots = 1"), "src_id").join(agents, "src_id").select("root", "path", "target_type", "agent_type", "agent", "privileges", *known, F.lit(True).alias("connector_managed"))
    return found, counted.where("roots != 1").select(F.col("src_id").alias("subject"), "roots")


def observed_memberships(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, groups) for each member (column name), those without any group included."""
    direct = neighbours(edges, "member_of", "group").select(F.col("src_id").alias("name"), F.col("dst_id").alias("group"))
    return members.select("name").distinct().join(direct, "name", "left").groupBy("name").agg(F.array_sort(F.collect_set("group")).alias("groups"))


def expand_nested(groups: DataFrame) -> DataFrame:
    """(group, ancestor): each group with itself and all groups above it, from (group, parent); cycles do no harm."""
    arcs = groups.where("parent IS NOT NULL").select(F.col("group").alias("src"), F.col("parent").alias("dst"))
    own = groups.select(F.col("group").alias("source")).distinct()
    above = reach(arcs, own).select(F.col("source").alias("group"), F.col("node").alias("ancestor"))
    return above.union(own.select(F.col("source").alias("group"), F.col("source").alias("ancestor"))).distinct()


def desired_groups(groups: DataFrame, names: DataFrame, writers: DataFrame) -> DataFrame:
    """(connector, name, member_of) from (group, parent), names (group, connector, local) and writers (connector, nested).

    Where groups can't nest, they have no parents; memberships are spread over ancestors instead (desired_memberships).
    """
    parents = groups.where("parent IS NOT NULL").join(names.select(F.col("group").alias("parent"), "connector", F.col("local").alias("up")), "parent").select("group", "connector", "up")
    x = names.join(F.broadcast(writers), "connector").join(parents, ["group", "connector"], "left")  # a handful of connectors
    up = F.array_sort(F.collect_set(F.when(F.col("nested"), F.col("up"))))
    return x.groupBy("connector", F.col("local").alias("name")).agg(up.alias("member_of"))


def desired_memberships(users: DataFrame, groups: DataFrame, names: DataFrame, writers: DataFrame) -> DataFrame:
    """(user_name, connector, groups) from users (user_name, group): with all ancestors where groups can't nest."""
    every = expand_nested(groups)
    wide = users.join(every, "group").select("user_name", F.col("ancestor").alias("group")).distinct()
    local = lambda df, nested: df.join(names, "group").join(F.broadcast(writers.where(F.col("nested") == nested)), "connector").select("user_name", "connector", "local")
    found = local(users.select("user_name", "group"), True).union(local(wide, False))
    return found.groupBy("user_name", "connector").agg(F.array_sort(F.collect_set("local")).alias("groups"))


def identify_assets(configured: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with asset, violations) for configured (connector, name, type) against assets of the same columns: exactly one must fit."""
    a = assets.select("connector", "name", F.col("type").alias("t"), "asset")
    on = (configured["connector"] == a["connector"]) & (configured["name"] == a["name"]) & configured["type"].eqNullSafe(a["t"])
    counted = configured.join(a, on, "left").groupBy(*[configured[c] for c in configured.columns]).agg(F.count("asset").alias("fits"), F.min("asset").alias("asset"))
    return counted.where("fits = 1").drop("fits"), counted.where("fits != 1").drop("asset")


def asset_files(configured: DataFrame) -> DataFrame:
    """(asset, file): where an asset is configured."""
    return configured.select(F.col("id").alias("asset"), "file").distinct()


def illegal_privileges(policies: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(asset, privilege) rows whose privilege the asset's type doesn't know: policies (asset, connector, asset_type, privileges)."""
    rows = policies.select("asset", "connector", "asset_type", F.explode("privileges").alias("privilege"))
    return rows.join(F.broadcast(catalogue), ["connector", "asset_type", "privilege"], "left_anti").select("asset", "privilege").distinct()  # a fixed table of under 200 rows


def content_permission_conflicts(defaults: DataFrame) -> DataFrame:
    """(root, values): projects whose default policies disagree on content permissions (root, target_type, content_permissions)."""
    rows = defaults.where("target_type = 'project'").groupBy("root").agg(F.countDistinct("content_permissions").alias("values"))
    return rows.where("values > 1")


def overlay_tags(edges: DataFrame, applied: DataFrame, removed: DataFrame) -> DataFrame:
    """The edges with those of matched tag targets (tag, asset) put on top."""
    from .build import with_inverses

    one = lambda df, kind: df.select(F.lit("asset").alias("src_type"), F.col("asset").alias("src_id"), F.lit("tag").alias("dst_type"), F.col("tag").alias("dst_id"), F.lit(kind).alias("edge_type"))
    return edges.unionByName(with_inverses(one(applied, "tagged_as").union(one(removed, "untagged_as")))).distinct()


def identities(rows: DataFrame) -> DataFrame:
    """(user_name, ids): every user's names on the connectors as ``connector=name``, sorted, from (user_name, connector, local)."""
    return rows.groupBy("user_name").agg(F.array_sort(F.collect_set(F.concat_ws("=", "connector", "local"))).alias("ids"))
