"""Requests for the BI server, as rows (stage, method, url, body); execution is up to the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import split_capability


def request(stage: int, method: str, url: Column, body: Column | None = None) -> list[Column]:
    return [F.lit(stage).alias("stage"), F.lit(method).alias("method"), url.alias("url"), (F.lit(None).cast("string") if body is None else body).alias("body")]


def groups(diffs: DataFrame, ids: DataFrame) -> DataFrame:
    """From a group diff (name, change); ``ids``: (name, id) of known groups. Nested groups aren't supported there."""
    add = diffs.where("change = 'add'").select(*request(0, "POST", F.lit("groups"), F.to_json(F.struct(F.struct("name").alias("group")))))
    gone = diffs.where("change = 'remove'").join(ids, "name")
    return add.union(gone.select(*request(0, "DELETE", F.concat(F.lit("groups/"), F.col("id")))))


def memberships(diffs: DataFrame, ids: DataFrame) -> DataFrame:
    """From a membership diff; a group that is still to be made is named instead of numbered."""
    known = ids.select(F.col("name").alias("x"), "id")
    group = F.coalesce("id", F.concat(F.lit("group_id_for_new_group_"), F.col("x")))
    one = lambda column: diffs.select("user_name", F.explode(column).alias("x")).join(known, "x", "left")
    add = one("to_add").select(*request(1, "POST", F.concat(F.lit("groups/"), group, F.lit("/users")), F.to_json(F.struct(F.struct(F.col("user_name").alias("id")).alias("user")))))
    return add.union(one("to_remove").select(*request(1, "DELETE", F.concat_ws("/", F.lit("groups"), group, F.lit("users"), "user_name"))))


def policies(diffs: DataFrame) -> DataFrame:
    """From a policy diff (kind, asset_id, agent_type, agent, to_add, to_remove) of mode-and-capability texts.

    One request per asset adds all grantees' capabilities; one per removed capability deletes it.
    """
    mode, capability = split_capability(F.col("x"))
    base = F.concat(F.col("kind"), F.lit("s/"), F.col("asset_id"), F.lit("/permissions"))
    added = F.transform("to_add", lambda x: F.struct(split_capability(x)[1].alias("name"), split_capability(x)[0].alias("mode")))
    per = diffs.where(F.size("to_add") > 0).select("kind", "asset_id", "agent_type", "agent", F.struct(F.struct(F.col("agent").alias("id"), F.col("agent_type").alias("type")).alias("grantee"), F.struct(added.alias("capability")).alias("capabilities")).alias("g"))
    body = per.groupBy("kind", "asset_id").agg(F.array_sort(F.collect_list("g")).alias("granteeCapabilities"))
    add = body.select(*request(2, "PUT", base, F.to_json(F.struct(F.struct("granteeCapabilities").alias("permissions")))))
    gone = diffs.withColumn("x", F.explode("to_remove"))
    return add.union(gone.select(*request(2, "DELETE", F.concat_ws("/", base, F.concat(F.col("agent_type"), F.lit("s")), "agent", capability, mode))))


def default_policies(diffs: DataFrame) -> DataFrame:
    """The same for default policies of projects (asset_id, target_type, ...); deletions come a stage earlier."""
    mode, capability = split_capability(F.col("x"))
    base = F.concat(F.lit("projects/"), F.col("asset_id"), F.lit("/default-permissions/"), F.col("target_type"), F.lit("s"))
    gone = diffs.withColumn("x", F.explode("to_remove")).select(*request(1, "DELETE", F.concat_ws("/", base, F.concat(F.col("agent_type"), F.lit("s")), "agent", capability, mode)))
    added = F.transform("to_add", lambda x: F.struct(split_capability(x)[1].alias("name"), split_capability(x)[0].alias("mode")))
    per = diffs.where(F.size("to_add") > 0).select("asset_id", "target_type", F.struct(F.struct(F.col("agent").alias("id"), F.col("agent_type").alias("type")).alias("grantee"), F.struct(added.alias("capability")).alias("capabilities")).alias("g"))
    body = per.groupBy("asset_id", "target_type").agg(F.array_sort(F.collect_list("g")).alias("granteeCapabilities"))
    return gone.union(body.select(*request(2, "PUT", base, F.to_json(F.struct(F.struct("granteeCapabilities").alias("permissions"))))))


def ordered(*plans: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, plans).orderBy("stage", "method", "url", "body")
