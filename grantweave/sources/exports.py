"""Exports of the warehouse and the BI server, as files of their own answers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import to_boolean

ENVELOPE = "resultSetMetaData struct<rowType:array<struct<name:string>>>, data array<array<string>>, partitionInfo array<struct<rowCount:bigint>>, statementHandle string"


def warehouse_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of query answers, one file per answer part; names compare in any case, nulls become empty texts."""
    raw = spark.read.schema(ENVELOPE).json(path, multiLine=True)
    rows = raw.select(F.transform("resultSetMetaData.rowType", lambda f: F.lower(f["name"])).alias("names"), F.explode("data").alias("row"))
    cell = F.map_from_arrays("names", "row")
    return rows.select(*[F.coalesce(F.element_at(cell, c.lower()), F.lit("")).alias(c) for c in columns])


#: Columns of the warehouse's lists.
LISTS = {
    "users": ("name", "first_name", "last_name", "email", "login_name", "display_name", "disabled"),
    "roles": ("name",),
    "databases": ("name", "origin"),
    "warehouses": ("name",),
    "schemas": ("name", "database_name"),
    "objects": ("name", "database_name", "schema_name", "kind"),
}


def listed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the warehouse's lists from its saved answers; a user's ``disabled`` becomes a boolean."""
    rows = warehouse_rows(spark, path, list(LISTS[kind]))
    return rows.withColumn("disabled", to_boolean(F.col("disabled"))) if kind == "users" else rows


def pages(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """Entries of a paged answer: a file per page, ``array`` the dotted place of the list, last page's entry per id standing."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.input_file_name().alias("file"), F.posexplode(F.from_json(F.get_json_object("value", "$." + array), f"array<struct<{schema}>>")).alias("at", "x"))
    return entries.groupBy("x.id").agg(F.max_by("x", F.struct("file", "at")).alias("x")).select("x.*")


def page_count(total: Column, size: Column) -> Column:
    return F.ceil(total / size)


CAPABILITIES = "array<struct<group:struct<id:string>, user:struct<id:string>, capabilities:struct<capability:array<struct<name:string, mode:string>>>>>"
#: Fixed value: a capability that isn't a permission of its own.
LEADER = "InheritedProjectLeader"


def grantees(answers: DataFrame) -> DataFrame:
    """(asset_id, agent_type, id, mode, capability) from (asset_id, granteeCapabilities json)."""
    g = answers.select("asset_id", F.explode(F.from_json("granteeCapabilities", CAPABILITIES)).alias("g"))
    agent = F.when(F.col("g.user").isNotNull(), "user").otherwise("group")
    flat = g.select("asset_id", agent.alias("agent_type"), F.coalesce("g.user.id", "g.group.id").alias("id"), F.explode("g.capabilities.capability").alias("c"))
    return flat.where(F.col("c.name") != LEADER).select("asset_id", "agent_type", "id", F.col("c.mode").alias("mode"), F.col("c.name").alias("capability"))


def agents(users: DataFrame, groups: DataFrame) -> DataFrame:
    return users.select("id", F.col("name").alias("agent"), F.lit("user").alias("agent_type")).unionByName(groups.select("id", F.col("name").alias("agent"), F.lit("group").alias("agent_type")))


def permissions(answers: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """(asset_id, agent_type, agent, privileges): mode and name joined. Grantees must be known: see ``unknown_grantees``."""
    kept = grantees(answers).join(agents(users, groups), ["id", "agent_type"])
    return kept.groupBy("asset_id", "agent_type", "agent").agg(F.array_sort(F.collect_set(F.concat("mode", "capability"))).alias("privileges"))


def unknown_grantees(answers: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """(asset_id, agent_type, id): grantees that are no known user or group, an error unless it is the default project's owner."""
    return grantees(answers).join(agents(users, groups), ["id", "agent_type"], "left_anti").select("asset_id", "agent_type", "id").distinct()


def permission_policies(found: DataFrame) -> DataFrame:
    """Policies named by asset and agent, so the same answers always give the same names."""
    return found.withColumn("name", F.sha1(F.concat_ws("|", "asset_id", "agent_type", "agent")))


def default_policies(found: DataFrame, *more: str) -> DataFrame:
    """Default permissions per project and type as policies on everything below (path /**)."""
    return found.select(F.col("asset_id").alias("root"), F.lit("/**").alias("path"), "target_type", "agent_type", "agent", "privileges", *more)


def cual_index(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """(cual, kind, id) over all kinds of BI assets."""
    out = None
    for kind, df in kinds:
        part = df.select("cual", F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def table_cuals(tables: DataFrame, databases: DataFrame, servers: DataFrame) -> DataFrame:
    """(table_id, cual): a table's database and server name its cual; tables that miss one are dropped."""
    x = tables.join(databases.withColumnsRenamed({"id": "database_id", "name": "database"}), "database_id").join(servers.withColumnsRenamed({"id": "server_id", "name": "server"}), "server_id")
    return x.select("table_id", F.concat(F.lit("snowflake://"), F.col("server"), F.lit("/"), F.concat_ws("/", "database", "schema", "name")).alias("cual"))


def lineage(assets: DataFrame, cuals: DataFrame) -> DataFrame:
    """(id, derived_from) from (id, upstream array of table ids); unknown tables are dropped."""
    x = assets.select("id", F.explode("upstream").alias("table_id")).join(cuals, "table_id")
    return x.groupBy("id").agg(F.array_sort(F.collect_set("cual")).alias("derived_from"))


def members(answers: DataFrame, users: DataFrame) -> DataFrame:
    """(group, users) from (group, user_id); unknown users are dropped."""
    return answers.join(users.select(F.col("id").alias("user_id"), "name"), "user_id").groupBy("group").agg(F.array_sort(F.collect_set("name")).alias("users"))


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """A table saved earlier; None where there is none that can be read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The graph's tables as ``sinks.export.snapshot`` wrote them."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges", "effective_permissions", "identity_map")}
