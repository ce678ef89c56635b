"""Warehouse exports: grants, future grants, memberships and include lists as policies, defaults and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import granted_on_name, privilege_name
from ..functions.paths import prefixes

#: Kinds of objects that take part.
KINDS = ("TABLE", "VIEW", "SCHEMA", "DATABASE")


def grant_scan(rows: DataFrame) -> DataFrame:
    """(role, kind, asset, privilege) of exported grants (name, table_catalog, table_schema, privilege, granted_on, grantee_name,
    deleted_on) that are still in force on kinds that take part; the filter reaches the scan."""
    kept = rows.where(((F.col("deleted_on") == "") | F.col("deleted_on").isNull()) & F.col("granted_on").isin(*KINDS))
    asset = granted_on_name(F.col("granted_on"), F.col("table_catalog"), F.col("table_schema"), F.col("name"))
    return kept.select(F.col("grantee_name").alias("role"), F.col("granted_on").alias("kind"), asset.alias("asset"), "privilege")


def grants_of_scan(rows: DataFrame) -> DataFrame:
    """(role, granted_to, grantee) of exported memberships (role, granted_to, grantee_name)."""
    return rows.select("role", F.upper("granted_to").alias("granted_to"), F.col("grantee_name").alias("grantee"))


def future_grant_scan(rows: DataFrame) -> DataFrame:
    """(role, name, target, privilege) of exported future grants (privilege, grant_on, name, grant_to, grantee_name); only those to roles count."""
    return rows.where(F.upper("grant_to") == "ROLE").select(F.col("grantee_name").alias("role"), "name", F.col("grant_on").alias("target"), "privilege")


def grants_to_policies(grants: DataFrame, owner: str = "snowflake") -> DataFrame:
    """(name, role, asset, privileges) from grants (role, kind, asset, privilege): one policy per role and asset."""
    kept = grants.where(F.col("kind").isin(*KINDS)).withColumn("privilege", privilege_name(F.col("privilege")))
    found = kept.groupBy("role", "asset").agg(F.array_sort(F.collect_set("privilege")).alias("privileges"))
    return found.select(F.concat_ws(".", F.lit(owner), "role", "asset").alias("name"), "role", "asset", "privileges")


def future_grants_to_defaults(grants: DataFrame) -> DataFrame:
    """(role, root, path, target_type, privileges) from future grants (role, name, target, privilege).

    The name ends with the kind in angle brackets (DB.SCHEMA.<TABLE>). What is granted on tables or views of a whole
    database lies two levels below it.
    """
    root = F.rtrim(F.substring_index("name", "<", 1), F.lit("."))
    deep = ~F.contains(root, F.lit(".")) & ~F.col("target").isin("SCHEMA")
    x = grants.where(F.col("target").isin(*KINDS)).select("role", root.alias("root"), F.when(deep, "/*/*").otherwise("/*").alias("path"), F.col("target").alias("target_type"), privilege_name(F.col("privilege")).alias("privilege"))
    return x.groupBy("role", "root", "path", "target_type").agg(F.array_sort(F.collect_set("privilege")).alias("privileges"))


def role_members(grants_of: DataFrame) -> DataFrame:
    """(kind, name, roles) from (role, granted_to, grantee); grantees other than users and roles are skipped."""
    return grants_of.where(F.col("granted_to").isin("USER", "ROLE")).groupBy(F.col("granted_to").alias("kind"), F.col("grantee").alias("name")).agg(F.array_sort(F.collect_set("role")).alias("roles"))


def expand_includes(patterns: DataFrame) -> DataFrame:
    """Include patterns and every dotted prefix above them."""
    return patterns.select(F.explode(prefixes(F.col("pattern"))).alias("pattern")).distinct()


def include(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Names that an expanded include list lets through. Open-ended patterns join as keys, too: names are cut at the lengths that
    such patterns have."""
    every = expand_includes(patterns)
    exact = names.join(every.select(F.col("pattern").alias("name")), "name", "left_semi")
    starts = every.where(F.endswith("pattern", F.lit("*"))).select(F.substr("pattern", F.lit(1), F.length("pattern") - 1).alias("start")).distinct()
    lengths = starts.agg(F.collect_set(F.length("start")).alias("lengths"))  # one row; different lengths are few
    cut = names.join(F.broadcast(lengths)).select("name", F.explode(F.filter("lengths", lambda n: n <= F.length("name"))).alias("n"))
    begun = cut.withColumn("start", F.substr("name", F.lit(1), F.col("n"))).join(starts, "start", "left_semi").select("name")
    return exact.unionByName(begun).distinct()


def children(assets: DataFrame) -> DataFrame:
    """(parent, child, kind) from assets with an array child_of."""
    return assets.select(F.explode("child_of").alias("parent"), F.col("asset").alias("child"), "kind").distinct()


def objects_to_assets(objects: DataFrame) -> DataFrame:
    """(asset, kind, parent) from (database, schema, name, kind), schema and name being null on higher levels."""
    asset = F.concat_ws(".", "database", "schema", "name")
    parent = F.when(F.col("name").isNotNull(), F.concat_ws(".", "database", "schema")).when(F.col("schema").isNotNull(), F.col("database"))
    return objects.select(asset.alias("asset"), "kind", parent.alias("parent"))
