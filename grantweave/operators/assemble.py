"""Putting connectors' tables together into one graph, and all differences between it and the configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import default_policy_name
from ..storage import stored
from . import build, policy
from .permissions import merge
from .traverse import default_targets

#: Entities in the order in which they join the graph, with their relations: column -> (edge type, type of the other end).
RELATIONS = {
    "group": {"member_of": ("member_of", "group"), "granted_by": ("granted_from", "policy")},
    "user": {"member_of": ("member_of", "group"), "granted_by": ("granted_from", "policy")},
    "asset": {"child_of": ("child_of", "asset"), "derived_from": ("derived_from", "asset"), "governed_by": ("governed_by", "policy"), "tagged_as": ("tagged_as", "tag")},
    "policy": {"governs": ("governs", "asset"), "granted_to_users": ("granted_to", "user"), "granted_to_groups": ("granted_to", "group")},
    "tag": {"applied_to": ("applied_to", "asset"), "removed_from": ("removed_from", "asset")},
}


def assemble(entities: dict[str, DataFrame], defaults: DataFrame, permissions: DataFrame, references: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, effective permissions) of one graph.

    ``entities``: a table per node type (see RELATIONS) of node_id, connectors, optional metadata, and array columns for its relations.
    ``references`` (node_id, derived_to) add edges of assets that other connectors own, never nodes. Edges come after all
    nodes; those with an end that is no node are left out. Default policies (root, path, target_type, agent_type, agent, privileges,
    metadata) come last, since what they cover depends on the hierarchy: each becomes a node with edges to its agent, its root
    and the assets it covers. Permissions (see schemas) are merged.
    """
    nodes, edges = [], []
    for kind, relations in RELATIONS.items():
        if kind in entities:
            df = entities[kind]
            keep = ["node_id", *[c for c in ("name", "connectors", "metadata", "privileges", "asset_type", "pass_through_hierarchy", "pass_through_lineage") if c in df.columns]]
            nodes.append(df.select(F.lit(kind).alias("node_type"), *keep))
            mine = {c: r for c, r in relations.items() if c in df.columns}
            if mine:
                edges.append(build.edges_of(df, kind, "node_id", mine))
    if references is not None:
        edges.append(build.edges_of(references, "asset", "node_id", {"derived_to": ("derived_to", "asset")}))
    every = stored(build.union_all(*nodes))
    known = every.select("node_type", "node_id").distinct()
    both = stored(inside(build.union_edges(*edges), known))
    below = both.where("edge_type = 'parent_of'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    named = defaults.withColumn("node_id", default_policy_name(F.concat_ws(":", "agent_type", "agent"), F.col("root"), F.col("path"), F.col("target_type")))
    kinds = every.where("node_type = 'asset'").select(F.col("node_id").alias("node"), F.col("asset_type").alias("kind"))
    covered = default_targets(below, named.select("node_id", "root", "path", "target_type"), kinds)
    mine = named.select(F.lit("default_policy").alias("node_type"), "node_id", "privileges", *(["metadata"] if "metadata" in named.columns else []))
    edge = lambda df, other, end, kind: df.select(F.lit("default_policy").alias("src_type"), F.col("node_id").alias("src_id"), other.alias("dst_type"), F.col(end).alias("dst_id"), F.lit(kind).alias("edge_type"))
    late = [
        edge(named, F.col("agent_type"), "agent", "granted_to"),
        edge(named, F.lit("asset"), "root", "provided_default_for_children"),
        edge(covered, F.lit("asset"), "node", "governs"),
    ]
    every = build.union_all(every, mine.distinct())
    late = inside(build.with_inverses(reduce(DataFrame.union, late)), every.select("node_type", "node_id").distinct())
    return every, build.union_edges(both, late), merge(permissions)


def inside(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    for end in ("src", "dst"):
        edges = edges.join(known.select(F.col("node_type").alias(f"{end}_type"), F.col("node_id").alias(f"{end}_id")), [f"{end}_type", f"{end}_id"], "left_semi")
    return edges.select("src_type", "src_id", "dst_type", "dst_id", "edge_type")


def change_identities(nodes: DataFrame, edges: DataFrame, identity_map: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user nodes, edges, identity map) after identities (connector, local_name, old, new) go from one user to another.

    Users that are named for the first time are added. Edges (user, other, connector, edge_type) of the old user whose other end belongs
    to the connector move to the new one; the connector moves from the old user's ``connectors`` to the new one's; users that
    are left without any connector go.
    """
    left = nodes.select("node_id", F.explode("connectors").alias("connector")).join(renames.select(F.col("old").alias("node_id"), "connector"), ["node_id", "connector"], "left_anti")
    held = left.union(renames.select(F.col("new").alias("node_id"), "connector")).distinct()
    users = held.groupBy("node_id").agg(F.array_sort(F.collect_set("connector")).alias("connectors"))
    return users, build.redirect_edges(edges, renames.select("old", "connector", "new").distinct()), build.remap_identities(identity_map, renames)


def translations(identity_map: DataFrame) -> DataFrame:
    """(connector, local_name, user_name), every local user once."""
    return identity_map.select("connector", "local_name", "user_name").distinct()


def of_connectors(tables: dict[str, DataFrame], *wanted: str) -> dict[str, DataFrame]:
    """The rows of some connectors; all of them if none is named."""
    return {name: df.where(F.col("connector").isin(*wanted)) for name, df in tables.items()} if wanted else dict(tables)


def all_diffs(wanted: dict[str, DataFrame], have: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """users, groups, policies and default_policies that differ between configuration and graph.

    Both sides give ``identities`` (user_name, connector, local_name), ``memberships`` (user_name, groups), ``groups`` (name, member_of),
    ``policies`` and ``default_policies``. Identities are compared first, and what the graph says of renamed users is read
    under their new names, so that the later differences don't repeat that change.
    """
    key = ["connector", "local_name"]
    identity = policy.identity_diff(wanted["identities"], have["identities"])
    # a user whose every local name goes to one other user is that user from here on
    to = have["identities"].join(wanted["identities"].withColumnRenamed("user_name", "new"), key, "left")
    renamed = to.groupBy("user_name").agg(F.min("new").alias("new"), F.countDistinct("new").alias("n"), F.count("*").alias("all"), F.count("new").alias("known")).where("n = 1 AND `all` = known AND new != user_name")
    renamed = stored(renamed.select("user_name", "new"))
    named = lambda df, c: df.join(renamed.withColumnRenamed("user_name", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    members = named(have["memberships"], "user_name").groupBy("user_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups"))

    def under_new_names(df: DataFrame) -> DataFrame:
        mine = named(df.where("agent_type = 'user'"), "agent").select(*df.columns)
        return df.where("agent_type != 'user'").unionByName(mine)

    return {
        "users": policy.user_diff(identity, policy.membership_diff(wanted["memberships"], members)),
        "groups": policy.in_order(policy.group_diff(wanted["groups"], have["groups"]), "name", fold_case=True),
        "policies": policy.in_order(policy.policy_diff(wanted["policies"], under_new_names(have["policies"])), "asset"),
        "default_policies": policy.in_order(policy.default_policy_diff(policy.lasting_defaults(wanted["default_policies"]), under_new_names(have["default_policies"])), "root"),
    }
