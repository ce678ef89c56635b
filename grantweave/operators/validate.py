"""Rules that configuration must keep, each giving rows of ``violations`` (rule, subject, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import split_group
from ..functions.paths import legal_wildcard


def found(rows: DataFrame, rule: str, subject: Column, *message: Column | str) -> DataFrame:
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return rows.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), F.concat(*parts).alias("message")).distinct()


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def groups(groups: DataFrame, connectors: DataFrame) -> DataFrame:
    """Rules of groups (name, identifiers map of connector to local name, member_of array) over connectors (connector)."""
    c = F.col
    prefix, _ = split_group(c("name"))
    above, _ = split_group(c("parent"))
    pinned = groups.select("name", prefix.alias("connector")).where("connector IS NOT NULL")
    up = groups.select("name", prefix.alias("connector"), F.explode("member_of").alias("parent")).withColumn("other", above)
    local = groups.select("name", F.explode("identifiers").alias("connector", "local"))
    twice = local.groupBy("connector", "local").agg(F.count("*").alias("n")).where("n > 1")
    known = lambda df: df.join(connectors.select("connector"), "connector", "left_anti")
    return together(
        found(known(pinned), "group prefix", c("name"), "no connector ", c("connector"), " for the prefix of group ", c("name")),
        found(up.join(groups.select(c("name").alias("parent")), "parent", "left_anti"), "unknown parent group", c("name"), "no group ", c("parent"), " in the configuration"),
        found(up.where("connector != other"), "group across connectors", c("name"), c("name"), " can't belong to ", c("parent"), " of another connector"),
        found(known(local), "group connector", c("name"), "no connector ", c("connector"), " in the project"),
        found(twice, "group mapped twice", c("local"), c("connector"), " group ", c("local"), " has several names"),
    )


def users(users: DataFrame, groups: DataFrame, connectors: DataFrame, local_users: DataFrame) -> DataFrame:
    """Rules of users (file, name, identifiers map, member_of array): names once, connectors legal, local names once and
    known, groups known, and every local user (connector, local) configured. ``groups``: (name)."""
    c = F.col
    local = users.select("file", "name", F.explode("identifiers").alias("connector", "local"))
    names = users.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    twice = local.groupBy("connector", "local").agg(F.count("*").alias("n")).where("n > 1")
    key = ["connector", "local"]
    member = users.select("name", F.explode("member_of").alias("group"))
    return together(
        found(names, "user named twice", c("name"), "several users are called ", c("name")),
        found(local.join(connectors.select("connector"), "connector", "left_anti"), "user connector", c("name"), "no connector ", c("connector"), " in the project"),
        found(twice, "user mapped twice", c("local"), c("connector"), " user ", c("local"), " has several configurations"),
        found(local.join(local_users.select(*key), key, "left_anti"), "unknown local user", c("name"), c("connector"), " has no user ", c("local")),
        found(member.join(groups.select(c("name").alias("group")), "group", "left_anti"), "unknown group", c("name"), "no group ", c("group"), " in the configuration"),
        found(local_users.select(*key).join(local.select(*key), key, "left_anti"), "user left out", c("local"), "no configuration for ", c("connector"), " user ", c("local")),
    )


def policies(policies: DataFrame, users: DataFrame, groups: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rules of policies (asset, connector, asset_type, agent_type, agent, privileges): agents known (users, groups: name), privileges
    legal for the asset's type (catalogue: connector, asset_type, privilege)."""
    c = F.col
    agents = users.select(F.lit("user").alias("agent_type"), c("name").alias("agent")).union(groups.select(F.lit("group").alias("agent_type"), c("name").alias("agent")))
    used = policies.select("asset", "connector", "asset_type", F.explode("privileges").alias("privilege"))
    return together(
        found(policies.join(agents, ["agent_type", "agent"], "left_anti"), "unknown agent", c("asset"), "no ", c("agent_type"), " ", c("agent"), " in the configuration"),
        found(used.join(catalogue, ["connector", "asset_type", "privilege"], "left_anti"), "illegal privilege", c("asset"), c("privilege"), " isn't known for ", c("asset_type")),
    )


def default_policies(defaults: DataFrame, users: DataFrame, groups: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The same for default policies (root, connector, path, target_type, ...); besides, the target type and the wildcard path must be legal."""
    c = F.col
    renamed = defaults.withColumnsRenamed({"root": "asset", "target_type": "asset_type"})
    types = catalogue.select("connector", "asset_type").distinct()
    return together(
        policies(renamed, users, groups, catalogue),
        found(renamed.join(types, ["connector", "asset_type"], "left_anti"), "illegal target type", c("asset"), "no type ", c("asset_type"), " at ", c("connector")),
        found(defaults.where(~legal_wildcard(c("path"))), "illegal path", c("root"), "not a wildcard path: ", c("path")),
    )
