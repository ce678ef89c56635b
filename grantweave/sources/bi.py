"""Entities of the BI server: typed tables of its nine kinds, their uniform names, and their assets.

Projects nest; workbooks, data sources and flows lie in projects, views in workbooks, metrics in views, lenses in data sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..capabilities import PRIVILEGES
from ..functions.cual import bi
from ..functions.names import table_parts
from ..operators.traverse import ancestor_chain
from . import exports

IN_PROJECT = "id string, name string, owner struct<id:string>, project struct<id:string>, updatedAt string"
#: The dotted place of each kind's list in an answer, and its fields.
KINDS = {
    "project": ("projects.project", "id string, name string, owner struct<id:string>, parentProjectId string, contentPermissions string"),
    "workbook": ("workbooks.workbook", IN_PROJECT),
    "view": ("views.view", IN_PROJECT + ", workbook struct<id:string>"),
    "datasource": ("datasources.datasource", IN_PROJECT),
    "flow": ("flows.flow", IN_PROJECT),
    "metric": ("metrics.metric", IN_PROJECT + ", underlyingView struct<id:string>"),
    "lens": ("lenses.lens", IN_PROJECT + ", datasource struct<id:string>"),
    "user": ("users.user", "id string, name string, email string, fullName string, externalAuthUserId string"),
    "group": ("groups.group", "id string, name string"),
}
#: The part of a default-permission address for each kind that has one.
DEFAULT_KINDS = {"workbooks": "workbook", "datasources": "datasource", "lenses": "lens", "flows": "flow", "metrics": "metric"}
CONTENT = "Tableau Content Permissions"


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One kind's entities from saved answer pages, one row per id."""
    array, schema = KINDS[kind]
    return exports.pages(spark, path, array, schema)


def parents(kind: str, df: DataFrame) -> DataFrame:
    """(id, name, kind, project_id, parent_id): the direct parent is a project, workbook, view or data source."""
    column = {"project": "parentProjectId", "view": "workbook.id", "metric": "underlyingView.id", "lens": "datasource.id"}.get(kind, "project.id")
    project = F.col("parentProjectId") if kind == "project" else F.col("project.id")
    return df.select("id", "name", F.lit(kind).alias("kind"), project.alias("project_id"), F.col(column).alias("parent_id"))


def assets(tables: dict[str, DataFrame], server: str) -> DataFrame:
    """(cual, id, name, kind, child_of, derived_from) of all seven kinds of assets; ``tables`` by kind (see KINDS).

    A name's path is its chain of projects, then workbook, view or data source; a project without parent stands alone. Views derive
    from their workbook, other kinds from their upstream tables (see exports.lineage).
    """
    every = reduce(DataFrame.unionByName, [parents(k, df) for k, df in tables.items() if k not in ("user", "group")])
    chain = ancestor_chain(every.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).where("parent IS NOT NULL"))
    up = every.select("id", "name", "kind", "parent_id").join(chain.select(F.col("node").alias("id"), "chain"), "id", "left")
    steps = up.select("id", F.posexplode(F.coalesce("chain", F.array().cast("array<string>"))).alias("at", "step"))
    named = steps.join(every.select(F.col("id").alias("step"), F.col("name").alias("above")), "step", "left")
    folders = named.groupBy("id").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("above", F.lit("Unknown")).alias("above")))), lambda x: x["above"])).alias("folders"))  # one asset's chain
    full = up.join(folders, "id", "left").withColumn("parts", F.concat(F.coalesce("folders", F.array().cast("array<string>")), F.array("name")))
    full = full.withColumn("cual", bi(F.lit(server), F.col("parts"), F.col("kind"))).select("id", "name", "kind", "parent_id", "cual")
    mother = full.select(F.col("id").alias("parent_id"), F.col("cual").alias("child_of"))
    x = full.join(mother, "parent_id", "left")
    return x.select("cual", "id", "name", "kind", "child_of", F.when(F.col("kind") == "view", F.col("child_of")).alias("derived_from"))


#: What the metadata service answers to the lineage questions.
LINEAGE = """data struct<databaseTables:array<struct<id:string, fullName:string, database:struct<id:string>>>, databases:array<struct<id:string, name:string>>,
  databaseServers:array<struct<id:string, hostName:string, connectionType:string>>, customSQLTables:array<struct<id:string, isUnsupportedCustomSql:boolean>>,
  assets:array<struct<luid:string, kind:string, upstreamTables:array<struct<id:string>>, downstreamTables:array<struct<id:string>>>>>"""


def lineage_answers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Saved answers of the metadata service: tables (table_id, full_name, database_id), databases (id, name), servers (id, host,
    connection), unsupported (table_id) of custom SQL that can't be followed, and uses (id, kind, direction, table_id)."""
    d = spark.read.schema(LINEAGE).json(path, multiLine=True).select("data.*")
    rows = lambda c: d.select(F.explode(c).alias("x")).select("x.*")
    assets = rows("assets")
    uses = lambda c, way: assets.select(F.col("luid").alias("id"), "kind", F.lit(way).alias("direction"), F.explode(c).alias("t")).select("id", "kind", "direction", F.col("t.id").alias("table_id"))
    return {
        "tables": rows("databaseTables").select(F.col("id").alias("table_id"), F.col("fullName").alias("full_name"), F.col("database.id").alias("database_id")),
        "databases": rows("databases"),
        "servers": rows("databaseServers").select("id", F.col("hostName").alias("host"), F.col("connectionType").alias("connection")),
        "unsupported": rows("customSQLTables").where("isUnsupportedCustomSql").select(F.col("id").alias("table_id")),
        "uses": uses("upstreamTables", "up").union(uses("downstreamTables", "down")),
    }


def table_cuals(answers: dict[str, DataFrame]) -> DataFrame:
    """(table_id, cual) of warehouse tables; a full name without its database gets the one the table belongs to, and tables without
    database, server, or a name of two or three parts are left out."""
    databases = answers["databases"].select(F.col("id").alias("database_id"), F.col("name").alias("database"))
    servers = answers["servers"].where("connection = 'snowflake'").select(F.col("id").alias("database_id"), "host")
    x = answers["tables"].join(databases, "database_id").join(servers, "database_id").withColumn("parts", table_parts(F.col("full_name")))
    x = x.where(F.size("parts").isin(2, 3)).withColumn("parts", F.when(F.size("parts") == 2, F.concat(F.array("database"), "parts")).otherwise(F.col("parts")))
    host = F.when(F.col("host") == "", "NO_HOSTNAME").otherwise(F.rtrim("host", F.lit("/")))
    return x.select("table_id", F.concat(F.lit("snowflake://"), host, F.lit("/"), F.array_join("parts", "/")).alias("cual"))


def only_of_views(privileges: str) -> Column:
    """Of a workbook's privileges those that views know, too."""
    known = F.array(*[F.lit(mode + p) for p in PRIVILEGES["tableau", "view"] for mode in ("Allow", "Deny")])
    return F.array_intersect(privileges, known)


def default_policies(projects: DataFrame, own: DataFrame, answers: DataFrame) -> DataFrame:
    """(root, path, target_type, agent_type, agent, privileges, metadata) of projects (id, contentPermissions).

    ``own``: the projects' permissions (asset_id, agent_type, agent, privileges), which are their defaults for projects and alone carry
    the content permissions as metadata. ``answers``: the same with ``place``, the default-permission address of other kinds;
    what holds for workbooks holds for views as far as they know the privilege.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in DEFAULT_KINDS.items() for x in pair]), F.col("place"))
    others = answers.where(F.col("place").isin(*DEFAULT_KINDS)).withColumn("target_type", kind).drop("place")
    views = others.where("target_type = 'workbook'").withColumns({"target_type": F.lit("view"), "privileges": only_of_views("privileges")})
    mine = own.withColumn("target_type", F.lit("project"))
    found = mine.unionByName(others).unionByName(views).join(projects.select(F.col("id").alias("asset_id"), "contentPermissions"), "asset_id")
    none = F.create_map().cast("map<string,string>")
    metadata = F.when(F.col("target_type") == "project", F.create_map(F.lit(CONTENT), "contentPermissions")).otherwise(none)
    return exports.default_policies(found.withColumn("metadata", metadata), "metadata")


def without_default_owner(permissions: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """Permissions (asset_id, agent_type, id, ...) without the owner of the top project "default" where no such user is known."""
    top = projects.where("name = 'default' AND parentProjectId IS NULL").select(F.col("id").alias("asset_id"))
    strangers = permissions.where("agent_type = 'user'").select("id").distinct().join(users.select("id"), "id", "left_anti")
    gone = permissions.where("agent_type = 'user'").join(top, "asset_id", "left_semi").join(strangers, "id", "left_semi").select("asset_id", "agent_type", "id").distinct()
    return permissions.join(gone, ["asset_id", "agent_type", "id"], "left_anti")
