"""From connector rows to one graph: names, nodes, edges, merging and resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import inverse_type


def global_names(local: DataFrame, identity_map: DataFrame, column: str = "local_name", out: str = "user_name") -> DataFrame:
    """Rows (connector, column, ...) with the name used everywhere; unknown ones keep a null name, see ``missing_names``."""
    m = identity_map.select("connector", F.col("local_name").alias(column), F.col("user_name").alias(out))
    return local.join(m, ["connector", column], "left")


def missing_names(local: DataFrame, identity_map: DataFrame, column: str = "local_name") -> DataFrame:
    """Rows whose local name nobody knows: an error for users, groups and policies."""
    return local.join(identity_map.select("connector", F.col("local_name").alias(column)), ["connector", column], "left_anti")


def resolve_prefix(rows: DataFrame, namespaces: DataFrame, cual: str = "cual", strict: bool = False) -> DataFrame:
    """Rows with the connector that owns their cual's prefix: (prefix, connector), one connector per prefix.

    Unknown prefixes are dropped (lineage) or kept with a null connector (``strict``: hierarchy, to be reported).
    """
    from ..functions import cual as C

    keyed = rows.withColumn("prefix", C.prefix(F.col(cual)))
    return keyed.join(namespaces.select("prefix", "connector"), "prefix", "left" if strict else "inner").drop("prefix")


def edges_of(entities: DataFrame, node_type: str, name: str, relations: dict[str, tuple[str, str]]) -> DataFrame:
    """Edges with their inverses from array columns: relations maps a column to (edge type, type of the other end)."""
    parts = [
        entities.select(F.lit(node_type).alias("src_type"), F.col(name).alias("src_id"), F.lit(other).alias("dst_type"), F.explode(column).alias("dst_id"), F.lit(edge).alias("edge_type"))
        for column, (edge, other) in relations.items()
    ]
    return with_inverses(reduce(DataFrame.unionByName, parts))


def with_inverses(edges: DataFrame) -> DataFrame:
    """The edges and their inverses, each once."""
    back = edges.select(
        F.col("dst_type").alias("src_type"), F.col("dst_id").alias("src_id"), F.col("src_type").alias("dst_type"), F.col("src_id").alias("dst_id"), inverse_type(F.col("edge_type")).alias("edge_type")
    )
    return edges.select(*back.columns).union(back).distinct()


def union_edges(*edges: DataFrame) -> DataFrame:
    """Edge tables together, each edge once."""
    return reduce(DataFrame.unionByName, edges).distinct()


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all connectors' tables; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_nodes(nodes: DataFrame, keys: list[str], sets: list[str], maps: list[str], scalars: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, conflicts): nodes with equal keys become one; sets and maps are united.

    A map key or scalar with two different values is a conflict: it appears in (keys, column, detail, values), and the least
    value stands in the merged node.
    """
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(s)))).alias(s) for s in sets]
    merged = nodes.groupBy(*keys).agg(*united, *[F.min(s).alias(s) for s in scalars])
    conflicts = []
    for m in maps:
        entries = nodes.select(*keys, F.explode(m).alias("k", "v")).groupBy(*keys, "k").agg(F.min("v").alias("v"), F.countDistinct("v").alias("values"))
        conflicts.append(entries.where("values > 1").select(*keys, F.lit(m).alias("column"), F.col("k").alias("detail"), "values"))
        one = entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(m))
        merged = merged.join(one, keys, "left")
    for s in scalars:
        counted = nodes.groupBy(*keys).agg(F.countDistinct(s).alias("values")).where("values > 1")
        conflicts.append(counted.select(*keys, F.lit(s).alias("column"), F.lit(None).cast("string").alias("detail"), "values"))
    return merged, reduce(DataFrame.unionByName, conflicts) if conflicts else merged.select(*keys).where("false")


def resolve_edges(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """References (ref, connector, path, asset_type or null) with the asset they mean (column asset), or null.

    A reference names an asset exactly, type included. Only one without a type may match by path alone, and only a
    unique asset of that path.
    """
    exact = assets.select("connector", "path", F.col("asset_type").alias("at"), F.col("asset").alias("exact"))
    loose = assets.groupBy("connector", "path").agg(F.count("*").alias("n"), F.min("asset").alias("one")).where("n = 1").select("connector", "path", "one")
    on = (refs["connector"] == exact["connector"]) & (refs["path"] == exact["path"]) & refs["asset_type"].eqNullSafe(exact["at"])
    x = refs.join(exact, on, "left").select(refs["*"], "exact").join(loose, ["connector", "path"], "left")
    return x.withColumn("asset", F.coalesce("exact", F.when(F.col("asset_type").isNull(), F.col("one")))).drop("exact", "one")


def redirect_edges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges of users that are renamed (old, new, connector): those whose other end belongs to the connector move.

    ``edges``: (user, other, connector, edge_type); the result is distinct.
    """
    to = renames.select(F.col("old").alias("user"), "connector", "new")
    moved = edges.join(to, ["user", "connector"], "left")
    return moved.select(F.coalesce("new", "user").alias("user"), "other", "connector", "edge_type").distinct()


def remap_identities(identity_map: DataFrame, renames: DataFrame) -> DataFrame:
    """The identity map after renames (connector, local_name, new)."""
    to = renames.select("connector", "local_name", "new")
    return identity_map.join(to, ["connector", "local_name"], "left").select("connector", "local_name", F.coalesce("new", "user_name").alias("user_name"))


def to_local(diffs: DataFrame, identity_map: DataFrame, name: str = "user_name") -> DataFrame:
    """Rows by global name and connector with the connector's own name; unknown ones keep the global name."""
    m = identity_map.select("connector", F.col("user_name").alias(name), F.col("local_name").alias("local"))
    return diffs.join(m, ["connector", name], "left").withColumn("local", F.coalesce("local", name))


def first_of(column: str, seq: str) -> Column:
    return F.min_by(column, seq)
