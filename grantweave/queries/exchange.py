"""Sources and sinks over files made from the star schema: each query writes its tables in an exchange format to shared storage and
reads them back through the library. Documents hold a bounded number of rows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import capabilities
from ..functions import cual, names, paths
from ..operators import assemble, build, explore, permissions, policy, state, traverse, validate, warehouse
from ..plans import bi_rest, warehouse_sql
from ..sinks import export
from ..sources import bi, config_yaml, connector, exports, manifest, paged
from ..storage import shared_path
from . import governance
from .derived import Tables
from .governance import POLICIES, flat, joined

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


def landed(docs: DataFrame) -> str:
    """The path of documents (doc, value), a file each."""
    path = shared_path(docs.sparkSession)
    docs.select(F.col("doc").cast("string").alias("doc"), "value").write.partitionBy("doc").text(path)
    return path


def lined(docs: DataFrame) -> str:
    """The path of documents (doc, value), each a line: a file each would cost more than its rows once there are tens of thousands."""
    path = shared_path(docs.sparkSession)
    docs.select("value").write.text(path)
    return path


def batch(key: str, size: int = 500) -> Column:
    """The number of the document that a row goes to."""
    return F.floor(F.col(key) / size).cast("string")


def document(rows: DataFrame, doc: Column, item: Column, wrap) -> DataFrame:
    """(doc, value): the items of each document in a list, wrapped and written as JSON."""
    return rows.groupBy(doc.alias("doc")).agg(F.collect_list(item).alias("items")).select("doc", F.to_json(wrap(F.col("items")), {"ignoreNullFields": "false"}).alias("value"))


# Transformation-tool manifests

RELATION = "'db.' || p_type || '.p' || p_partkey"
MODELS = f"""WITH m AS (SELECT 'model.p' || p_partkey AS unique_id, CASE WHEN p_size > 40 THEN 'model.p' || p_partkey ELSE {RELATION} END AS relation, p_size > 40 AS ephemeral, p_size < 30 AS enabled, p_brand AS description FROM {{part}}
  UNION ALL SELECT DISTINCT 'model.b' || p_brand, 'db.brands.' || p_brand, false, NULL::BOOLEAN, NULL FROM {{part}})"""
ARCS = f"""SELECT DISTINCT 'raw.s.' || l_suppkey AS src, {RELATION} AS dst FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE p_size <= 40
  UNION SELECT 'raw.s.' || l_suppkey, 'db.brands.' || p_brand FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE p_size > 40
  UNION SELECT {RELATION}, 'db.brands.' || p_brand FROM {{part}} WHERE p_size <= 40"""


def part_manifest(t: Tables) -> DataFrame:
    s = lambda x: F.lit(x).cast("string")
    config = lambda enabled, made: F.struct(enabled.alias("enabled"), made.alias("materialized"))

    def node(unique_id, relation, kind, cfg, fqn, schema, description):
        body = F.struct(unique_id.alias("unique_id"), relation.alias("relation_name"), F.lit(kind).alias("resource_type"), cfg.alias("config"), fqn.alias("fqn"), F.lit("db").alias("database"), schema.alias("schema"), description.alias("description"))
        return F.struct(unique_id.alias("key"), body.alias("value"))

    part_id = F.concat(F.lit("model.p"), "p_partkey")
    nodes = lambda items: F.struct(F.map_from_entries(items).alias("nodes"))
    # some relations are spelt out, others follow from database, schema and name
    spelt = F.when(F.col("p_brand") != "Brand#2", F.concat(F.lit('"db"."'), "p_type", F.lit('"."p'), "p_partkey", F.lit('"')))
    own = node(part_id, spelt, "model", config(F.col("p_size") < 30, F.when(F.col("p_size") > 40, "ephemeral").otherwise("table")), F.array(F.lit("x"), F.concat(F.lit("p"), "p_partkey")), F.col("p_type"), F.col("p_brand"))
    brand_id = F.concat(F.lit("model.b"), "p_brand")
    brand = node(brand_id, s(None), "snapshot", config(F.lit(None).cast("boolean"), s(None)), F.array("p_brand"), F.lit("brands"), s(None))
    test = node(F.concat(F.lit("test.p"), "p_partkey"), s(None), "test", config(F.lit(True), s(None)), F.array(F.lit("t")), F.lit("x"), s(None))
    source = F.struct(F.concat(F.lit("source.s"), "s_suppkey").alias("key"), F.struct(F.concat(F.lit('"raw"."s"."'), "s_suppkey", F.lit('"')).alias("relation_name")).alias("value"))
    feeds = t.lineitem.select("l_suppkey", "l_partkey").repartition("l_suppkey").distinct().groupBy("l_suppkey").agg(F.transform(F.collect_list("l_partkey"), lambda x: F.concat(F.lit("model.p"), x)).alias("cs"))  # a supplier's parts
    arcs = lambda items: F.struct(F.map_from_entries(items).alias("child_map"))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    down = entry(part_id, F.array(brand_id, F.concat(F.lit("test.p"), "p_partkey")))
    docs = [
        document(t.part, F.concat(F.lit("m"), batch("p_partkey")), own, nodes),
        document(t.part, F.concat(F.lit("t"), batch("p_partkey")), test, nodes),
        document(t.part.select("p_brand").distinct(), F.lit("b"), brand, nodes),
        document(t.supplier, F.concat(F.lit("s"), batch("s_suppkey")), source, lambda items: F.struct(F.map_from_entries(items).alias("sources"))),
        document(feeds, F.concat(F.lit("a"), batch("l_suppkey", 20)), entry(F.concat(F.lit("source.s"), "l_suppkey"), F.col("cs")), arcs),
        document(t.part, F.concat(F.lit("d"), batch("p_partkey")), down, arcs),
    ]
    every = docs[0]
    for d in docs[1:]:
        every = every.union(d)
    return manifest.read(t.spark, lined(every), lines=True)


@query(MODELS + " SELECT unique_id, relation, ephemeral, enabled, description FROM m")
def op_s01_models(t: Tables) -> DataFrame:
    return manifest.models(part_manifest(t)).select("unique_id", "relation", "ephemeral", "enabled", "description")


@query(MODELS + " SELECT unique_id FROM m WHERE NOT ephemeral")
def op_s02_materialized_models(t: Tables) -> DataFrame:
    return manifest.models(part_manifest(t)).where("NOT ephemeral").select("unique_id")


@query(MODELS + " SELECT unique_id, relation FROM m UNION ALL SELECT 'source.s' || s_suppkey, 'raw.s.' || s_suppkey FROM {supplier}")
def op_s04_relation_names(t: Tables) -> DataFrame:
    m = part_manifest(t)
    return manifest.models(m).select("unique_id", "relation").union(manifest.sources(m))


@query("SELECT 'source.s' || s_suppkey AS unique_id, 'raw.s.' || s_suppkey AS relation FROM {supplier}")
def op_s03_manifest_sources(t: Tables) -> DataFrame:
    return manifest.sources(part_manifest(t))


@query(ARCS)
def op_s05_manifest_lineage(t: Tables) -> DataFrame:
    return manifest.lineage(part_manifest(t))


@query("WITH a AS (" + ARCS + ") SELECT src, string_agg(dst, ',' ORDER BY dst) AS dsts FROM a GROUP BY src")
def op_s07_child_map(t: Tables) -> DataFrame:
    return manifest.lineage(part_manifest(t)).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("dsts"))  # of one relation


@query(MODELS + ", a AS (" + ARCS + """), u AS (SELECT relation, enabled, description FROM m WHERE NOT ephemeral UNION ALL SELECT 'raw.s.' || s_suppkey, NULL, NULL FROM {supplier}),
  c AS (SELECT src, string_agg('snowflake://acct.snowflakecomputing.com/' || replace(replace(upper(dst), '.', '/'), '#', '%23'), ',' ORDER BY 'snowflake://acct.snowflakecomputing.com/' || replace(replace(upper(dst), '.', '/'), '#', '%23')) AS derived_to FROM a GROUP BY src)
  SELECT 'snowflake://acct.snowflakecomputing.com/' || replace(replace(upper(relation), '.', '/'), '#', '%23') AS cual, enabled, description, coalesce(derived_to, '') AS derived_to FROM u LEFT JOIN c ON c.src = u.relation""")
def op_s08_asset_references(t: Tables) -> DataFrame:
    return manifest.references(part_manifest(t), "acct").select("cual", "enabled", "description", joined("derived_to"))


# Warehouse answers


def answers(rows: DataFrame, doc: Column, fields: tuple[str, ...]) -> str:
    """Rows as parts of a query's answer; ``fields`` are names as the warehouse spells them, in the columns' order."""
    cells = F.array(*[F.col(c).cast("string") for c in rows.columns])
    meta = F.struct(F.array(*[F.struct(F.lit(f).alias("name")) for f in fields]).alias("rowType"))
    return landed(document(rows, doc, cells, lambda items: F.struct(meta.alias("resultSetMetaData"), items.alias("data"), F.lit("h").alias("statementHandle"))))


@query("SELECT c_custkey::VARCHAR AS key, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS segment FROM {customer}")
def op_s09_warehouse_answers(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return exports.warehouse_rows(t.spark, answers(rows, batch("c_custkey"), ("KEY", "Name", "SEGMENT")), ["key", "name", "segment"])


@query("""SELECT 'users' AS list, c_name AS name, c_mktsegment || '|' || (c_acctbal < 0)::VARCHAR AS detail FROM {customer} UNION ALL SELECT 'roles', n_name, '' FROM {nation} UNION ALL SELECT 'databases', n_name, 'o' FROM {nation}
  UNION ALL SELECT 'warehouses', r_name, '' FROM {region} UNION ALL SELECT 'schemas', n_name, 'r' || n_regionkey FROM {nation} UNION ALL SELECT 'objects', p_name, p_type || '|' || p_brand || '|TABLE' FROM {part}""")
def op_s10_metadata_lists(t: Tables) -> DataFrame:
    none, key = F.lit("").alias("none"), lambda n: F.lit("0") if n is None else batch(n)
    made = {
        "users": (t.customer.select("c_name", none, none, none, none, "c_mktsegment", (F.col("c_acctbal") < 0).cast("string"), "c_custkey"), "c_custkey", ("display_name", "disabled")),
        "roles": (t.nation.select("n_name"), None, ()), "databases": (t.nation.select("n_name", F.lit("o")), None, ("origin",)), "warehouses": (t.region.select("r_name"), None, ()),
        "schemas": (t.nation.select("n_name", F.concat(F.lit("r"), "n_regionkey")), None, ("database_name",)),
        "objects": (t.part.select("p_name", "p_type", "p_brand", F.lit("TABLE"), "p_partkey"), "p_partkey", ("database_name", "schema_name", "kind")),
    }

    def one(kind: str) -> DataFrame:
        rows, doc, detail = made[kind]
        rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        place = key(None if doc is None else rows.columns[-1])
        got = exports.listed(t.spark, answers(rows, place, (*exports.LISTS[kind], *(["id"] if doc else []))), kind)
        return got.select(F.lit(kind).alias("list"), "name", F.concat_ws("|", *[F.col(c).cast("string") for c in detail]).alias("detail"))

    return build.union_all(*[one(k) for k in made])


GRANTS = """WITH g AS (SELECT p_name AS name, 'DB' AS table_catalog, p_type AS table_schema, CASE WHEN p_size > 20 THEN 'SELECT' ELSE 'REFERENCE USAGE' END AS privilege,
  CASE WHEN p_brand LIKE '%1' THEN 'SCHEMA' WHEN p_brand LIKE '%2' THEN 'DATABASE' WHEN p_brand LIKE '%3' THEN 'STAGE' WHEN p_brand LIKE '%4' THEN 'VIEW' ELSE 'TABLE' END AS granted_on,
  p_brand AS grantee_name, CASE WHEN p_retailprice > 1000 THEN '2020-01-01' END AS deleted_on, p_partkey FROM {part})"""


def exported_grants(t: Tables) -> DataFrame:
    ends = lambda d: F.endswith("p_brand", F.lit(d))
    kind = F.when(ends("1"), "SCHEMA").when(ends("2"), "DATABASE").when(ends("3"), "STAGE").when(ends("4"), "VIEW").otherwise("TABLE")
    rows = t.part.select("p_name", F.lit("DB").alias("c"), "p_type", F.when(F.col("p_size") > 20, "SELECT").otherwise("REFERENCE USAGE").alias("p"), kind.alias("k"), "p_brand", F.when(F.col("p_retailprice") > 1000, "2020-01-01").alias("d"), "p_partkey")
    fields = ("NAME", "TABLE_CATALOG", "TABLE_SCHEMA", "PRIVILEGE", "GRANTED_ON", "GRANTEE_NAME", "DELETED_ON", "ID")
    return exports.warehouse_rows(t.spark, answers(rows, batch("p_partkey"), fields), [f.lower() for f in fields])


FQN = "CASE granted_on WHEN 'DATABASE' THEN table_catalog WHEN 'SCHEMA' THEN table_catalog || '.' || name ELSE concat_ws('.', table_catalog, table_schema, name) END"


@query(GRANTS + f" SELECT grantee_name AS role, granted_on AS kind, {FQN} AS asset, privilege FROM g WHERE deleted_on IS NULL AND granted_on <> 'STAGE'")
def op_s11_grant_scan(t: Tables) -> DataFrame:
    return warehouse.grant_scan(exported_grants(t))


@query(GRANTS + f" SELECT p_partkey::VARCHAR AS id, {FQN} AS asset FROM g WHERE granted_on <> 'STAGE'")
def op_f15_grant_names(t: Tables) -> DataFrame:
    g = exported_grants(t).where("granted_on != 'STAGE'")
    return g.select("id", names.granted_on_name(*[F.col(c) for c in ("granted_on", "table_catalog", "table_schema", "name")]).alias("asset"))


@query("SELECT kind, name, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'USER' ELSE 'ROLE' END AS kind, c_name AS name, c_mktsegment AS role FROM {customer}) x GROUP BY kind, name")
def op_s12_role_members_scan(t: Tables) -> DataFrame:
    rows = t.customer.select("c_mktsegment", F.when(F.col("c_acctbal") < 0, "User").otherwise("ROLE").alias("g"), "c_name", "c_custkey")
    got = exports.warehouse_rows(t.spark, answers(rows, batch("c_custkey"), ("role", "granted_to", "grantee_name", "id")), ["role", "granted_to", "grantee_name"])
    return warehouse.role_members(warehouse.grants_of_scan(got)).select("kind", "name", joined("roles"))


@query("SELECT DISTINCT p_brand AS role, 'DB.' || p_type AS root, '/*' AS path, 'TABLE' AS target_type, 'SELECT' AS privileges FROM {part}")
def op_s12_future_grants_scan(t: Tables) -> DataFrame:
    rows = t.part.select(F.lit("SELECT").alias("p"), F.lit("TABLE").alias("k"), F.concat(F.lit("DB."), "p_type", F.lit(".<TABLE>")).alias("n"), F.lit("role").alias("to"), "p_brand", "p_partkey")
    fields = ["privilege", "grant_on", "name", "grant_to", "grantee_name", "id"]
    got = exports.warehouse_rows(t.spark, answers(rows, batch("p_partkey"), tuple(fields)), fields)
    return warehouse.future_grants_to_defaults(warehouse.future_grant_scan(got)).select("role", "root", "path", "target_type", joined("privileges"))


def saved_pages(rows: DataFrame, resource: str, place: str, size: int, key: str) -> str:
    """The path of each resource's rows as pages of ``size`` entries, with their pagination."""
    outer, inner = place.split(".")
    total = rows.groupBy(resource).agg(F.count("*").alias("total"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(resource).orderBy(key))).join(total, resource)
    fields = [c for c in rows.columns if c != resource]
    pages = numbered.groupBy(F.col(resource).alias("resource"), F.ceil(F.col("n") / size).cast("int").alias("page"), "total").agg(F.collect_list(F.struct(*fields)).alias("items"))
    info = F.struct(F.lit(str(size)).alias("pageSize"), F.col("total").cast("string").alias("totalAvailable"))
    path = shared_path(rows.sparkSession)
    pages.select("resource", "page", F.to_json(F.struct(info.alias("pagination"), F.struct(F.col("items").alias(inner)).alias(outer))).alias("value")).write.partitionBy("resource", "page").text(path)
    return path


@query("SELECT c_mktsegment AS resource, 'u' || c_custkey AS id, c_name AS name, c_acctbal < 0 AS disabled FROM {customer} WHERE c_acctbal >= 0")
def op_s13_paged_users(t: Tables) -> DataFrame:
    """Users of sites, page by page; disabled ones are left out by the reader."""
    rows = t.customer.select("c_mktsegment", F.concat(F.lit("u"), "c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("disabled"))
    entries = paged.answers(t.spark, saved_pages(rows, "c_mktsegment", "users.user", 100, "id"), "users.user", "id string, name string, disabled boolean")
    return entries.where("disabled = false").select("resource", "id", "name", "disabled")


@query("SELECT p_brand AS role, p_name AS name, min(p_type) AS kind FROM {part} WHERE p_size <= 45 GROUP BY p_brand, p_name")
def op_s12_grants_by_role(t: Tables) -> DataFrame:
    """Grants of every role, a request list per role; grants that were taken back are left out by the reader."""
    rows = t.part.select("p_brand", F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.when(F.col("p_size") > 45, "gone").alias("deleted_on"))
    entries = paged.answers(t.spark, saved_pages(rows, "p_brand", "data.grants", 50, "id"), "data.grants", "id string, name string, kind string, deleted_on string")
    return entries.where("deleted_on IS NULL").groupBy(F.col("resource").alias("role"), "name").agg(F.min("kind").alias("kind"))


# BI answers


def listing(rows: DataFrame, doc: Column, place: str) -> str:
    """Entities as answer pages, in a list at a dotted place."""
    outer, inner = place.split(".")
    return landed(document(rows, doc, F.struct(*rows.columns), lambda items: F.struct(F.struct(items.alias(inner)).alias(outer))))


def within(c: Column) -> Column:
    return F.struct(c.alias("id"))


def entities(t: Tables) -> dict[str, DataFrame]:
    """All nine kinds, written as answers and read back."""
    tag = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    none = F.lit(None).cast("string")
    projects = t.region.select(tag("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), none.alias("parentProjectId"), F.lit("LockedToProject").alias("contentPermissions"), F.lit("0").alias("doc"))
    projects = projects.union(t.nation.select(tag("n", "n_nationkey"), "n_name", tag("r", "n_regionkey"), F.when(F.col("n_nationkey") < 10, "ManagedByOwner").otherwise("LockedToProject"), F.lit("1")))
    part_project = tag("n", "home")
    parts = t.part.withColumn("home", F.col("p_size") % 25)
    rows = {
        "project": projects,
        "workbook": parts.select(tag("w", "p_partkey").alias("id"), F.col("p_name").alias("name"), within(part_project).alias("project"), batch("p_partkey").alias("doc")),
        "view": parts.select(tag("v", "p_partkey").alias("id"), F.col("p_brand").alias("name"), within(part_project).alias("project"), within(tag("w", "p_partkey")).alias("workbook"), batch("p_partkey").alias("doc")),
        "metric": parts.select(tag("m", "p_partkey").alias("id"), F.col("p_type").alias("name"), within(part_project).alias("project"), within(tag("v", "p_partkey")).alias("underlyingView"), batch("p_partkey").alias("doc")),
        "datasource": t.supplier.select(tag("d", "s_suppkey").alias("id"), F.col("s_name").alias("name"), within(tag("n", "s_nationkey")).alias("project"), batch("s_suppkey").alias("doc")),
        "lens": t.supplier.select(tag("l", "s_suppkey").alias("id"), F.lit("lens").alias("name"), within(tag("n", "s_nationkey")).alias("project"), within(tag("d", "s_suppkey")).alias("datasource"), batch("s_suppkey").alias("doc")),
        "flow": t.customer.select(tag("f", "c_custkey").alias("id"), F.col("c_name").alias("name"), within(tag("n", "c_nationkey")).alias("project"), batch("c_custkey").alias("doc")),
        "user": t.customer.select(tag("u", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat("c_name", F.lit("@x.org")).alias("email"), batch("c_custkey").alias("doc")),
        "group": t.customer.select(F.concat(F.lit("g"), "c_mktsegment").alias("id"), F.col("c_mktsegment").alias("name"), F.lit("0").alias("doc")).distinct(),
    }
    return {k: bi.read(t.spark, listing(df, F.col("doc"), bi.KINDS[k][0]), k) for k, df in rows.items()}


ENTITIES = """WITH e AS (SELECT 'project' AS kind, 'r' || r_regionkey AS id, r_name AS name FROM {region} UNION ALL SELECT 'project', 'n' || n_nationkey, n_name FROM {nation}
  UNION ALL SELECT 'workbook', 'w' || p_partkey, p_name FROM {part} UNION ALL SELECT 'view', 'v' || p_partkey, p_brand FROM {part} UNION ALL SELECT 'metric', 'm' || p_partkey, p_type FROM {part}
  UNION ALL SELECT 'datasource', 'd' || s_suppkey, s_name FROM {supplier} UNION ALL SELECT 'lens', 'l' || s_suppkey, 'lens' FROM {supplier} UNION ALL SELECT 'flow', 'f' || c_custkey, c_name FROM {customer}
  UNION ALL SELECT 'user', 'u' || c_custkey, c_name FROM {customer} UNION ALL SELECT DISTINCT 'group', 'g' || c_mktsegment, c_mktsegment FROM {customer})"""


@query(ENTITIES + " SELECT kind, id, name FROM e")
def op_s14_bi_entities(t: Tables) -> DataFrame:
    return build.union_all(*[df.select(F.lit(k).alias("kind"), "id", "name") for k, df in entities(t).items()])


@query("SELECT 'u' || c_custkey AS id, c_name AS name, c_name || '@x.org' AS email FROM {customer}")
def op_s13_answer_pages(t: Tables) -> DataFrame:
    return entities(t)["user"].select("id", "name", "email")


ENC = "replace(replace({}, ' ', '%20'), '#', '%23')"
BI_ASSETS = f"""WITH p AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'project' AS kind, NULL AS parent_id FROM {{region}} UNION ALL SELECT 'n' || n_nationkey, n_name, 'project', 'r' || n_regionkey FROM {{nation}}
  UNION ALL SELECT 'w' || p_partkey, p_name, 'workbook', 'n' || (p_size % 25) FROM {{part}} UNION ALL SELECT 'v' || p_partkey, p_brand, 'view', 'w' || p_partkey FROM {{part}} UNION ALL SELECT 'm' || p_partkey, p_type, 'metric', 'v' || p_partkey FROM {{part}}
  UNION ALL SELECT 'd' || s_suppkey, s_name, 'datasource', 'n' || s_nationkey FROM {{supplier}} UNION ALL SELECT 'l' || s_suppkey, 'lens', 'lens', 'd' || s_suppkey FROM {{supplier}} UNION ALL SELECT 'f' || c_custkey, c_name, 'flow', 'n' || c_nationkey FROM {{customer}}),
  x AS (SELECT id, kind, parent_id, {ENC.format("name")} AS path FROM p WHERE parent_id IS NULL UNION ALL SELECT p.id, p.kind, p.parent_id, x.path || '/' || {ENC.format("p.name")} FROM p JOIN x ON x.id = p.parent_id),
  c AS (SELECT id, kind, parent_id, 'tableau://site/' || path || '?type=' || kind AS cual FROM x)"""


@query("WITH RECURSIVE " + BI_ASSETS.removeprefix("WITH ") + " SELECT c.cual, c.id, c.kind, m.cual AS child_of, CASE WHEN c.kind = 'view' THEN m.cual END AS derived_from FROM c LEFT JOIN c m ON m.id = c.parent_id")
def op_m15_bi_assets(t: Tables) -> DataFrame:
    return bi.assets(entities(t), "site").select("cual", "id", "kind", "child_of", "derived_from")


@query("WITH RECURSIVE " + BI_ASSETS.removeprefix("WITH ") + " SELECT cual, kind, id FROM c WHERE kind IN ('workbook', 'flow')")
def op_j26_cual_index(t: Tables) -> DataFrame:
    every = bi.assets(entities(t), "site")
    return exports.cual_index(*[(k, every.where(F.col("kind") == k)) for k in ("workbook", "flow")])


CAPABILITY = "CASE WHEN event_type IN ('view', 'click') THEN 'Read' WHEN event_type = 'error' THEN 'InheritedProjectLeader' ELSE 'Write' END"


def permission_answers(t: Tables) -> DataFrame:
    """(asset_id, granteeCapabilities): every event is a capability of its user, or for low values of a group, on the asset its user stands for."""
    kind = F.when(F.col("event_type").isin("view", "click"), "Read").when(F.col("event_type") == "error", "InheritedProjectLeader").otherwise("Write")
    mode = F.when(F.col("value") < 50, "Deny").otherwise("Allow")
    none = F.lit(None).cast("struct<id:string>")
    user, low = F.struct(F.concat(F.lit("u"), "user_id").alias("id")), F.col("value") < 10
    one = F.struct(F.when(low, F.struct(F.lit("g0").alias("id"))).otherwise(none).alias("group"), F.when(~low, user).otherwise(none).alias("user"), F.struct(F.array(F.struct(kind.alias("name"), mode.alias("mode"))).alias("capability")).alias("capabilities"))
    rows = t.events.select((F.col("user_id") % 20).alias("a"), F.floor(F.col("event_id") / 200).alias("part"), one.alias("g"))
    return rows.groupBy("a", "part").agg(F.to_json(F.collect_list("g")).alias("granteeCapabilities")).select(F.concat(F.lit("n"), "a").alias("asset_id"), "granteeCapabilities")


def agents(t: Tables) -> tuple[DataFrame, DataFrame]:
    users = t.events.where("user_id < 60").select(F.concat(F.lit("u"), "user_id").alias("id"), F.concat(F.lit("user "), "user_id").alias("name")).distinct()
    return users, t.spark.createDataFrame([("g0", "everyone")], "id string, name string")


BI_PERMISSIONS = f"""WITH e AS (SELECT 'n' || (user_id % 20) AS asset_id, CASE WHEN value < 10 THEN 'group' ELSE 'user' END AS agent_type, CASE WHEN value < 10 THEN 'everyone' ELSE 'user ' || user_id END AS agent, value < 10 OR user_id < 60 AS known,
  CASE WHEN value < 10 THEN 'g0' ELSE 'u' || user_id END AS id, CASE WHEN value < 50 THEN 'Deny' ELSE 'Allow' END || {CAPABILITY} AS privilege FROM {{events}} WHERE event_type <> 'error'),
  p AS (SELECT asset_id, agent_type, agent, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges FROM e WHERE known GROUP BY asset_id, agent_type, agent)"""


@query(BI_PERMISSIONS + " SELECT * FROM p")
def op_s15_bi_permissions(t: Tables) -> DataFrame:
    return exports.permissions(permission_answers(t), *agents(t)).select("asset_id", "agent_type", "agent", joined("privileges"))


@query(BI_PERMISSIONS + " SELECT DISTINCT asset_id, agent_type, id FROM e WHERE NOT known")
def op_s15_unknown_grantees(t: Tables) -> DataFrame:
    return exports.unknown_grantees(permission_answers(t), *agents(t))


@query(BI_PERMISSIONS + " SELECT sha1(concat_ws('|', asset_id, agent_type, agent)) AS name, privileges FROM p")
def op_m14_permission_policies(t: Tables) -> DataFrame:
    return exports.permission_policies(exports.permissions(permission_answers(t), *agents(t))).select("name", joined("privileges"))


@query(BI_PERMISSIONS + """, q AS (SELECT *, CASE WHEN CAST(substr(asset_id, 2) AS INT) < 10 THEN 'ManagedByOwner' ELSE 'LockedToProject' END AS c FROM p)
  SELECT asset_id AS root, '/**' AS path, 'project' AS target_type, agent_type, agent, privileges, 'Tableau Content Permissions=' || c AS metadata FROM q
  UNION ALL SELECT asset_id, '/**', 'workbook', agent_type, agent, privileges, '' FROM q UNION ALL SELECT asset_id, '/**', 'flow', agent_type, agent, privileges, '' FROM q
  UNION ALL SELECT asset_id, '/**', 'view', agent_type, agent, array_to_string(list_filter(string_split(privileges, ','), lambda x: x NOT LIKE '%Write'), ','), '' FROM q""")
def op_s16_bi_defaults(t: Tables) -> DataFrame:
    own = exports.permissions(permission_answers(t), *agents(t))
    places = t.spark.createDataFrame([("workbooks",), ("flows",), ("databases",)], "place string")
    found = bi.default_policies(entities(t)["project"], own, own.join(F.broadcast(places)))  # three rows
    return found.select("root", "path", "target_type", "agent_type", "agent", joined("privileges"), flat("metadata"))


@query("SELECT DISTINCT 'n' || (user_id % 20) AS asset_id, 'user' AS agent_type, 'u' || user_id AS id FROM {events} WHERE event_type <> 'error' AND value >= 10 AND (user_id < 60 OR user_id % 20 <> 3) UNION SELECT 'n' || (user_id % 20), 'group', 'g0' FROM {events} WHERE event_type <> 'error' AND value < 10")
def op_p10_default_owner(t: Tables) -> DataFrame:
    projects = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 3, "default").otherwise(F.col("n_name")).alias("name"), F.lit(None).cast("string").alias("parentProjectId"))
    rows = exports.grantees(permission_answers(t)).select("asset_id", "agent_type", "id").distinct()
    return bi.without_default_owner(rows, projects, agents(t)[0])


@query("SELECT c_mktsegment AS \"group\", string_agg(c_name, ',' ORDER BY c_name) AS users FROM {customer} WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def op_s17_group_members(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("user_id"))
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return exports.members(rows, known).select("group", joined("users"))


def bi_tables(t: Tables) -> DataFrame:
    tables = t.part.select(F.col("p_partkey").alias("table_id"), F.col("p_type").alias("schema"), F.col("p_brand").alias("name"), F.col("p_size").alias("database_id"))
    databases = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("server_id"))
    return exports.table_cuals(tables, databases, t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


TABLE_CUALS = "c AS (SELECT p_partkey AS table_id, 'snowflake://' || r_name || '/' || concat_ws('/', n_name, p_type, p_brand) AS cual FROM {part} JOIN {nation} ON p_size = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)"


@query("WITH " + TABLE_CUALS + " SELECT * FROM c")
def op_j09_table_cuals(t: Tables) -> DataFrame:
    return bi_tables(t).select("table_id", "cual")


@query("WITH " + TABLE_CUALS + " SELECT l_suppkey AS id, string_agg(DISTINCT cual, ',' ORDER BY cual) AS derived_from FROM {lineitem} JOIN c ON c.table_id = l_partkey GROUP BY l_suppkey")
def op_j10_bi_lineage(t: Tables) -> DataFrame:
    assets = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("l_partkey").alias("upstream"))
    return exports.lineage(assets, bi_tables(t)).select("id", joined("derived_from"))


@query("""WITH c AS (SELECT 't' || p_partkey AS table_id, 'snowflake://' || CASE WHEN n_regionkey = 0 THEN 'NO_HOSTNAME' ELSE 'h' || n_regionkey END || '/' || CASE WHEN p_partkey % 2 = 0 THEN n_name || '/' || p_type || '/' || p_name ELSE 'DB/' || upper(p_type) || '/' || p_name END AS cual FROM {part} JOIN {nation} ON p_size = n_nationkey WHERE p_retailprice < 1500)
  SELECT 'd' || l_suppkey AS id, string_agg(DISTINCT cual, ',' ORDER BY cual) AS derived_from FROM {lineitem} JOIN c ON c.table_id = 't' || l_partkey GROUP BY l_suppkey""")
def op_s18_lineage_answers(t: Tables) -> DataFrame:
    part, nation, n = F.concat(F.lit("t"), "p_partkey"), t.nation, F.col("n_nationkey")
    # names come in brackets without their database, or in full with the last part quoted; some have a single part and are left out
    brackets = F.concat(F.lit("["), "p_type", F.lit("].["), "p_name", F.lit("]"))
    full = F.concat(F.lit("db."), "p_type", F.lit('."'), "p_name", F.lit('"'))
    name = F.when(F.col("p_retailprice") >= 1500, "alone").when(F.col("p_partkey") % 2 == 0, brackets).otherwise(full)
    table = F.struct(part.alias("id"), name.alias("fullName"), within(F.col("p_size").cast("string")).alias("database"))
    host = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("h"), "n_regionkey", F.lit("/")))
    feeds = t.lineitem.select("l_suppkey", within(F.concat(F.lit("t"), "l_partkey")).alias("x")).distinct().groupBy("l_suppkey").agg(F.collect_list("x").alias("xs"))  # a supplier's parts
    asset = F.struct(F.concat(F.lit("d"), "l_suppkey").alias("luid"), F.lit("datasource").alias("kind"), F.col("xs").alias("upstreamTables"))
    wrap = lambda field: lambda items: F.struct(F.struct(items.alias(field)).alias("data"))
    docs = document(t.part, F.concat(F.lit("t"), batch("p_partkey")), table, wrap("databaseTables"))
    docs = docs.union(document(nation, F.lit("d"), F.struct(n.cast("string").alias("id"), F.col("n_name").alias("name")), wrap("databases")))
    docs = docs.union(document(nation, F.lit("s"), F.struct(n.cast("string").alias("id"), host.alias("hostName"), F.lit("snowflake").alias("connectionType")), wrap("databaseServers")))
    docs = docs.union(document(feeds, F.concat(F.lit("a"), batch("l_suppkey", 20)), asset, wrap("assets")))
    got = bi.lineage_answers(t.spark, landed(docs))
    upstream = got["uses"].where("direction = 'up'").groupBy("id").agg(F.collect_list("table_id").alias("upstream"))
    return exports.lineage(upstream, bi.table_cuals(got)).select("id", joined("derived_from"))


# Configuration files


@query("SELECT c_name AS name, 'user ' || c_custkey AS local, c_mktsegment || ',all' AS groups FROM {customer}")
def op_s19_yaml_users(t: Tables) -> DataFrame:
    item = F.struct(F.col("c_name").alias("name"), F.create_map(F.lit("crm"), F.concat(F.lit("user "), "c_custkey")).alias("identifiers"), F.array("c_mktsegment", F.lit("all")).alias("groups"))
    found = config_yaml.users(t.spark, landed(document(t.customer, batch("c_custkey"), item, lambda items: items)), files="*")
    return found.select("name", F.col("identifiers")["crm"].alias("local"), joined("groups"))


def nation_files(t: Tables) -> str:
    """A file of users for each nation: where a name is missing, in the region 3, or a list is never closed, in the region 2."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when((F.col("n_regionkey") == 3) & (F.col("c_acctbal") < 0), "- groups: [none]").otherwise(F.concat(F.lit("- name: "), "c_name"))
    entries = rows.groupBy(F.col("n_nationkey").alias("doc"), "n_regionkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", name.alias("x")))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["x"]), "\n")
    return landed(entries.select("doc", F.when(F.col("n_regionkey") == 2, F.concat(F.lit("- name: [\n"), text)).otherwise(text).alias("value")))


CONFIGURED = "WITH c AS (SELECT n_nationkey AS doc, n_regionkey AS r, c_name, c_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS line FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey)"


def document_number() -> Column:
    return F.regexp_extract("file", "doc=([0-9]+)", 1).cast("long").alias("doc")


@query(CONFIGURED + """ SELECT doc, line::INTEGER AS line, 3 AS "column", 'name is missing' AS message, '- groups: [none]' AS context FROM c WHERE r = 3 AND c_acctbal < 0
  UNION ALL SELECT doc, 2, 1, 'while parsing a flow node expected the node content', '- name: ' || c_name FROM c WHERE r = 2 AND line = 1""")
def op_f24_configuration_errors(t: Tables) -> DataFrame:
    found = config_yaml.problems(t.spark, nation_files(t), files="*", required=("name",))
    return found.select(document_number(), "line", "column", F.substring_index("message", ",", 1).alias("message"), "context")


@query(CONFIGURED + " SELECT doc, c_name AS name FROM c WHERE r <> 2 AND NOT (r = 3 AND c_acctbal < 0)")
def op_s19_files_beside_broken_ones(t: Tables) -> DataFrame:
    return config_yaml.read(t.spark, nation_files(t), config_yaml.USERS, files="*", required=("name",), strict=False).select(document_number(), "name")


@query("SELECT n_name AS name, 'REGION ' || n_regionkey AS member_of FROM {nation}")
def op_s20_yaml_groups(t: Tables) -> DataFrame:
    item = F.struct(F.col("n_name").alias("name"), F.array(F.concat(F.lit("REGION "), "n_regionkey")).alias("member of"))
    return config_yaml.groups(t.spark, landed(document(t.nation, F.lit("groups"), item, lambda items: items)), files="*").select("name", joined("member_of"))


@query("""SELECT 'tag' || n_nationkey AS tag, n_name AS pattern, CASE WHEN n_regionkey > 1 THEN 'table' END AS kind FROM {nation}""")
def op_s21_yaml_tag_targets(t: Tables) -> DataFrame:
    # a target is a name, or a mapping of name and type
    plain, typed = F.concat(F.lit('"'), "n_name", F.lit('"')), F.to_json(F.struct(F.col("n_name").alias("name"), F.lit("table").alias("type")))
    body = F.concat(F.lit("tag"), "n_nationkey", F.lit(":\n  description: d\n  apply_to: ["), F.when(F.col("n_regionkey") > 1, typed).otherwise(plain), F.lit("]\n"))
    docs = t.nation.select(F.col("n_nationkey").alias("doc"), body.alias("value"))
    return config_yaml.tag_targets(config_yaml.tags(t.spark, landed(docs), files="*"))


def asset_documents(t: Tables) -> DataFrame:
    """(file, id, ..., policies, default_policies): a document per batch of suppliers; each supplier lets its nation's group do something."""
    group = F.array(F.concat(F.lit("nation "), "s_nationkey"))
    policies = F.array(F.struct(group.alias("groups"), F.array(F.when(F.col("s_acctbal") < 0, "OWN").otherwise("READ")).alias("privileges")))
    defaults = F.array(F.struct(F.lit("/**").alias("path"), F.lit("view").alias("target type"), (F.col("s_acctbal") > 5000).alias("connector-managed"), group.alias("groups"), F.array(F.lit("USE")).alias("privileges")))
    item = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("dw").alias("connector"), F.col("s_name").alias("name"), policies.alias("policies"), defaults.alias("default policies"))
    return config_yaml.assets(t.spark, landed(document(t.supplier, batch("s_suppkey"), item, lambda items: items)), files="*")


@query("SELECT 's' || s_suppkey AS asset, 'group' AS agent_type, 'nation ' || s_nationkey AS agent, CASE WHEN s_acctbal < 0 THEN 'OWN' ELSE 'READ' END AS privileges FROM {supplier}")
def op_s19_yaml_policies(t: Tables) -> DataFrame:
    return config_yaml.policies(asset_documents(t)).select("asset", "agent_type", "agent", joined("privileges"))


@query("SELECT 's' || s_suppkey AS root, '/**' AS path, 'view' AS target_type, 'nation ' || s_nationkey AS agent FROM {supplier} WHERE s_acctbal > 5000")
def op_p11_lasting_defaults(t: Tables) -> DataFrame:
    return policy.lasting_defaults(config_yaml.default_policies(asset_documents(t))).select("root", "path", "target_type", "agent")


@query("SELECT 's' || s_suppkey AS asset, floor(s_suppkey / 500)::BIGINT AS doc FROM {supplier}")
def op_m17_asset_files(t: Tables) -> DataFrame:
    return state.asset_files(asset_documents(t)).select("asset", F.regexp_extract("file", r"doc=([0-9]+)", 1).cast("long").alias("doc"))


# Snapshots and sinks


@query("SELECT c_custkey AS id, c_name AS name FROM {customer}")
def op_k01_snapshot(t: Tables) -> DataFrame:
    path, ids = shared_path(t.spark), t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    export.snapshot({"nodes": ids, "edges": t.hier, "effective_permissions": t.perms, "identity_map": ids}, path)
    return exports.snapshot(t.spark, path)["nodes"]


@query("SELECT src, dst FROM {hier}")
def op_s23_snapshot_edges(t: Tables) -> DataFrame:
    path, ids = shared_path(t.spark), t.nation
    export.snapshot({"nodes": ids, "edges": t.hier, "effective_permissions": t.perms, "identity_map": ids}, path)
    return exports.snapshot(t.spark, path)["edges"]


@query("SELECT n_name AS name FROM {nation} UNION ALL SELECT 'none' WHERE true")
def op_s24_cached_environment(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    t.nation.select(F.col("n_name").alias("name")).write.parquet(path)
    missing = exports.cached(t.spark, path + "-absent")
    other = missing if missing is not None else t.spark.range(1).select(F.lit("none").alias("name"))
    return exports.cached(t.spark, path).union(other)


@query('SELECT \'"\' || n_nationkey || \'","\' || n_name || \'"\' || chr(13) AS line FROM {nation} UNION ALL SELECT \'"n_nationkey","n_name"\' || chr(13)')
def op_k04_csv(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    export.csv(t.nation.select("n_nationkey", "n_name").coalesce(1), path)  # 25 rows
    return t.spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


@query("SELECT 1 AS line_no, '  \"' || src || '\" -> \"' || dst || '\";' AS line FROM {hier} UNION ALL SELECT 0, 'digraph {' UNION ALL SELECT 2, '}'")
def op_k02_dot(t: Tables) -> DataFrame:
    return export.dot(t.hier)


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","gone":null}' AS value FROM {nation}""")
def op_k03_json(t: Tables) -> DataFrame:
    return export.json(t.nation.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("gone")))


@query("""SELECT c_name AS name, '{"name":"' || c_name || '","groups":["' || c_mktsegment || '"]}' AS document FROM {customer}""")
def op_k05_documents(t: Tables) -> DataFrame:
    return export.documents(t.customer.select(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("groups")), "name")


@query("""SELECT n_name AS name, '{"name":"' || n_name || '","members":' || count(c_custkey) || '}' AS document FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name""")
def op_m16_bootstrap_documents(t: Tables) -> DataFrame:
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("members"))
    return export.documents(rows, "name")


@query("""SELECT '{"user":[' || (SELECT string_agg(DISTINCT '"' || n_name || '"', ',' ORDER BY '"' || n_name || '"') FROM {nation}) || '],"group":[' || (SELECT string_agg(DISTINCT '"' || c_mktsegment || '"', ',' ORDER BY '"' || c_mktsegment || '"') FROM {customer})
  || '],"privilege":[' || (SELECT string_agg(DISTINCT '"' || p_type || '"', ',' ORDER BY '"' || p_type || '"') FROM {part}) || ']}' AS schema""")
def op_k08_editor_schema(t: Tables) -> DataFrame:
    return export.editor_schema(t.nation.select(F.col("n_name").alias("user")), t.customer.select(F.col("c_mktsegment").alias("group")), t.part.select(F.col("p_type").alias("privilege")))


# Plans


@query("WITH " + governance.MEMBER + ", " + governance.set_diff("mw", "mh", "user_name", "g") + """, m AS (SELECT * FROM d WHERE change = 'modify'), a AS (SELECT user_name, unnest(string_split(to_add, ',')) AS x FROM m WHERE to_add <> ''), r AS (SELECT user_name, unnest(string_split(to_remove, ',')) AS x FROM m WHERE to_remove <> ''),
  s AS (SELECT 2 AS stage, 'GRANT ROLE "' || x || '" TO USER "' || user_name || '";' AS statement FROM a UNION ALL SELECT 2, 'REVOKE ROLE "' || x || '" FROM USER "' || user_name || '";' FROM r)
  SELECT stage, row_number() OVER (PARTITION BY stage ORDER BY statement) AS seq, statement FROM s""")
def op_k06_plan_memberships(t: Tables) -> DataFrame:
    return warehouse_sql.ordered(warehouse_sql.memberships(governance.memberships(t)))


@query("""WITH g AS (SELECT n_name AS name, n_regionkey AS r, n_nationkey AS k FROM {nation}) SELECT 0 AS stage, 'POST' AS method, 'groups' AS url, '{"group":{"name":"' || name || '"}}' AS body FROM g WHERE r < 2
  UNION ALL SELECT 0, 'DELETE', 'groups/id' || k, NULL FROM g WHERE r > 2""")
def op_k07_plan_groups(t: Tables) -> DataFrame:
    diffs = t.nation.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 2, "add").when(F.col("n_regionkey") > 2, "remove").otherwise("modify").alias("change"))
    ids = t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("id"), "n_nationkey").alias("id"))
    return bi_rest.ordered(bi_rest.groups(diffs, ids))


@query("""WITH d AS (SELECT 'n' || n_nationkey AS root, n_name AS agent, n_regionkey AS r FROM {nation}), s AS (SELECT 'GRANT READ, WRITE ON FUTURE TABLES IN SCHEMA ' || root || ' TO ROLE "' || agent || '";' AS statement FROM d WHERE r < 3
  UNION ALL SELECT 'GRANT OWNERSHIP ON FUTURE TABLES IN SCHEMA ' || root || ' TO ROLE "' || agent || '" COPY CURRENT GRANTS;' FROM d WHERE r < 3 UNION ALL SELECT 'REVOKE ALL ON FUTURE TABLES IN SCHEMA ' || root || ' FROM ROLE "' || agent || '";' FROM d WHERE r >= 3) SELECT 2 AS stage, statement FROM s""")
def op_m10_plan_defaults(t: Tables) -> DataFrame:
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    new = F.col("n_regionkey") < 3
    diffs = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("root"), F.lit("SCHEMA").alias("root_kind"), F.lit("TABLE").alias("target_type"), F.lit("group").alias("agent_type"), F.col("n_name").alias("agent"), F.when(new, "add").otherwise("remove").alias("change"), F.when(new, texts("OWNERSHIP", "READ", "WRITE")).otherwise(texts()).alias("to_add"), F.when(new, texts()).otherwise(texts("READ")).alias("to_remove"))
    return warehouse_sql.default_policies(diffs)


@query("""SELECT 2 AS stage, 'PUT' AS method, 'workbooks/n' || n_nationkey || '/permissions' AS url, '{"permissions":{"granteeCapabilities":[{"grantee":{"id":"' || n_name || '","type":"user"},"capabilities":{"capability":[{"name":"Read","mode":"Allow"}]}}]}}' AS body FROM {nation}
  UNION ALL SELECT 2, 'DELETE', 'workbooks/n' || n_nationkey || '/permissions/users/' || n_name || '/Write/Deny', NULL FROM {nation}""")
def op_m11_plan_policies(t: Tables) -> DataFrame:
    one = lambda x: F.array(F.lit(x))
    return bi_rest.policies(t.nation.select(F.lit("workbook").alias("kind"), F.concat(F.lit("n"), "n_nationkey").alias("asset_id"), F.lit("user").alias("agent_type"), F.col("n_name").alias("agent"), one("AllowRead").alias("to_add"), one("DenyWrite").alias("to_remove")))


@query("""SELECT 1 AS stage, 'DELETE' AS method, 'projects/n' || n_nationkey || '/default-permissions/flows/groups/' || n_name || '/Write/Deny' AS url, NULL AS body FROM {nation}
  UNION ALL SELECT 2, 'PUT', 'projects/n' || n_nationkey || '/default-permissions/flows', '{"permissions":{"granteeCapabilities":[{"grantee":{"id":"' || n_name || '","type":"group"},"capabilities":{"capability":[{"name":"Read","mode":"Allow"}]}}]}}' FROM {nation}""")
def op_m11_plan_defaults(t: Tables) -> DataFrame:
    one = lambda x: F.array(F.lit(x))
    return bi_rest.default_policies(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("asset_id"), F.lit("flow").alias("target_type"), F.lit("group").alias("agent_type"), F.col("n_name").alias("agent"), one("AllowRead").alias("to_add"), one("DenyWrite").alias("to_remove")))


@query("""SELECT 1 AS stage, row_number() OVER (ORDER BY c_name) AS seq, 'CREATE ROLE "' || c_name || '";' AS statement FROM {customer}""")
def op_s25_connector_plan(t: Tables) -> DataFrame:
    """A role for every customer, planned by the connector from its own saved table."""
    path = shared_path(t.spark)
    t.customer.select(F.col("c_name").alias("name")).write.parquet(f"{path}/roles")
    w = connector.Warehouse(t.spark, path, ("roles",))
    none = F.array().cast("array<string>")
    return w.plan({"groups": w.tables()["roles"].where(F.lit(w.check())).select("name", F.lit("add").alias("change"), none.alias("to_add"), none.alias("to_remove"))})


# Names, joins and sets


@query("""WITH k AS (SELECT CASE WHEN p_size > 40 THEN 'DATABASE' WHEN p_size > 20 THEN 'TABLE' ELSE 'lens' END AS asset_type, p_brand FROM {part}),
  c AS (SELECT 'snowflake' AS connector, 'TABLE' AS asset_type, 8 AS n UNION ALL SELECT 'snowflake', 'DATABASE', 7 UNION ALL SELECT 'tableau', 'lens', 10)
  SELECT connector, asset_type, p_brand AS brand, count(*) AS assets, sum(n)::BIGINT AS privileges FROM k JOIN c USING (asset_type) GROUP BY connector, asset_type, p_brand""")
def op_p13_capabilities(t: Tables) -> DataFrame:
    """What connectors that write groups allow on the parts as assets."""
    kind = F.when(F.col("p_size") > 40, "DATABASE").when(F.col("p_size") > 20, "TABLE").otherwise("lens")
    assets = t.part.select("p_partkey", F.col("p_brand").alias("brand"), kind.alias("asset_type"))
    allowed = capabilities.catalogue(t.spark).join(capabilities.group_writers(t.spark), "connector").select("connector", "asset_type", "privilege")
    return assets.join(allowed, "asset_type").groupBy("connector", "asset_type", "brand").agg(F.countDistinct("p_partkey").alias("assets"), F.count("*").alias("privileges"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'secure' END AS connector FROM {pages}")
def op_j03_strict_prefixes(t: Tables) -> DataFrame:
    spaces = t.pages.select(cual.prefix(F.col("url")).alias("prefix")).where("prefix LIKE 'https%'").distinct().withColumn("connector", F.lit("secure"))
    return build.resolve_prefix(t.pages.select("page_id", F.col("url").alias("cual")), spaces, strict=True).select("page_id", "connector")


@query("""SELECT 'd' || r_regionkey AS id, 'region:' || r_regionkey AS root, '/*' AS path, 'user:' || r_regionkey AS agent, 'READ' AS privileges, 'region=' || r_name AS metadata, true AS connector_managed FROM {region} WHERE r_regionkey < 3""")
def op_j13_observed_defaults(t: Tables) -> DataFrame:
    return observed_defaults(t)[0].select(F.concat(F.lit("d"), F.substring_index("root", ":", -1)).alias("id"), "root", "path", "agent", joined("privileges"), flat("metadata"), "connector_managed")


def observed_defaults(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Default policies of regions; those of region 3 on have two roots, a violation."""
    mine = F.concat(F.lit("d"), "r_regionkey")
    nodes = t.region.select(F.lit("default_policy").alias("node_type"), mine.alias("node_id"), F.lit("/*").alias("matching_path"), F.lit("nation").alias("target_type"), F.array(F.lit("READ")).alias("privileges"), F.create_map(F.lit("region"), "r_name").alias("metadata"))
    edge = lambda df, kind, c, name: df.select(F.lit("default_policy").alias("src_type"), mine.alias("src_id"), F.lit(kind).alias("dst_type"), c.alias("dst_id"), F.lit(name).alias("edge_type"))
    root = F.concat(F.lit("region:"), "r_regionkey")
    edges = edge(t.region, "asset", root, "provided_default_for_children").union(edge(t.region.where("r_regionkey > 2"), "asset", F.lit("region:x"), "provided_default_for_children"))
    return state.observed_default_policies(nodes, edges.union(edge(t.region, "user", F.concat(F.lit("user:"), "r_regionkey"), "granted_to")))


@query("SELECT 'd' || r_regionkey AS subject, 2::BIGINT AS roots FROM {region} WHERE r_regionkey > 2")
def op_j13_default_root_violations(t: Tables) -> DataFrame:
    return observed_defaults(t)[1]


@query("""SELECT 'p' || p_partkey AS name, CASE WHEN p_size < 25 THEN 'b' END AS type, 'a' || p_partkey AS asset FROM {part} WHERE p_size < 25""")
def op_j22_identified_assets(t: Tables) -> DataFrame:
    return identified(t)[0].select("name", "type", "asset")


def identified(t: Tables) -> tuple[DataFrame, DataFrame]:
    name, dw = F.concat(F.lit("p"), "p_partkey").alias("name"), F.lit("dw").alias("connector")
    wanted = t.part.select(dw, name, F.when(F.col("p_size") < 25, "b").alias("type"))
    assets = t.part.select(dw, name, F.lit("b").alias("type"), F.concat(F.lit("a"), "p_partkey").alias("asset"))
    return state.identify_assets(wanted, assets)


@query("SELECT 'p' || p_partkey AS name, 0::BIGINT AS fits FROM {part} WHERE p_size >= 25")
def op_j22_unidentified_assets(t: Tables) -> DataFrame:
    return identified(t)[1].select("name", "fits")


@query("SELECT p_type AS key, 'left' AS side FROM {part} GROUP BY p_type EXCEPT SELECT 'ECONOMY', 'left' UNION ALL SELECT 'nothing', 'right'")
def op_j24_missing_and_extra(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("ECONOMY",), ("nothing",)], "key string")
    return policy.two_sided(t.part.select(F.col("p_type").alias("key")), known, "key")


@query("SELECT 'crm' AS connector, c_name AS user_name, CASE WHEN c_acctbal > 0 THEN 'local ' || c_custkey ELSE c_name END AS local FROM {customer}")
def op_j25_local_names(t: Tables) -> DataFrame:
    known = t.customer.where("c_acctbal > 0").select(F.lit("crm").alias("connector"), F.col("c_name").alias("user_name"), F.concat(F.lit("local "), "c_custkey").alias("local_name"))
    return build.to_local(t.customer.select(F.lit("crm").alias("connector"), F.col("c_name").alias("user_name")), known).select("connector", "user_name", "local")


def group_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups with parents, their names by connector, and the connectors that write groups (groups nest at the warehouse alone)."""
    mark = lambda m, c: F.concat(F.lit(m), F.col(c))
    groups = t.nation.select(F.col("n_name").alias("group"), mark("R", "n_regionkey").alias("parent")).union(t.region.select(mark("R", "r_regionkey"), F.lit(None).cast("string")))
    writers = capabilities.group_writers(t.spark)
    named = policy.group_names(groups.select("group"), writers, t.spark.createDataFrame([], "group string, connector string, local string"))
    return groups, named, writers


@query("SELECT 'snowflake' AS connector, n_name AS name, 'R' || n_regionkey AS member_of FROM {nation} UNION ALL SELECT 'tableau', n_name, '' FROM {nation} UNION ALL SELECT c, 'R' || r_regionkey, '' FROM {region}, (SELECT 'snowflake' AS c UNION ALL SELECT 'tableau') x")
def op_j27_desired_groups(t: Tables) -> DataFrame:
    return state.desired_groups(*group_tables(t)).select("connector", "name", joined("member_of"))


@query("SELECT c_name AS user_name, 'snowflake' AS connector, n_name AS groups FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey UNION ALL SELECT c_name, 'tableau', n_name || ',R' || n_regionkey FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey")
def op_j27_desired_memberships(t: Tables) -> DataFrame:
    users = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("user_name"), F.col("n_name").alias("group"))
    return state.desired_memberships(users, *group_tables(t)).select("user_name", "connector", joined("groups"))


@query(BI_PERMISSIONS + " SELECT asset_id AS root, '/**' AS path, agent, privileges FROM p WHERE agent_type = 'group'")
def op_s16_default_rows(t: Tables) -> DataFrame:
    found = exports.permissions(permission_answers(t), *agents(t)).where("agent_type = 'group'").withColumn("target_type", F.lit("flow"))
    return exports.default_policies(found).select("root", "path", "agent", joined("privileges"))


@query("SELECT DISTINCT 'user' AS kind, c_name AS name FROM {customer} UNION ALL SELECT DISTINCT 'group', c_mktsegment FROM {customer} UNION ALL SELECT DISTINCT 'privilege', p_type FROM {part}")
def op_r06_schema_names(t: Tables) -> DataFrame:
    one = export.editor_schema(t.customer.select(F.col("c_name").alias("user")), t.customer.select(F.col("c_mktsegment").alias("group")), t.part.select(F.col("p_type").alias("privilege")))
    kinds = F.from_json("schema", "user array<string>, `group` array<string>, privilege array<string>").alias("k")
    return build.union_all(*[one.select(kinds).select(F.lit(k).alias("kind"), F.explode(f"k.{k}").alias("name")) for k in ("user", "group", "privilege")])


@query(POLICIES + " SELECT asset, agent, change FROM d")
def op_r02_sorted_diffs(t: Tables) -> DataFrame:
    return policy.in_order(governance.policies_diff(t), "asset").select("asset", "agent", "change")


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM {customer} UNION ALL SELECT s_name, NULL, s_acctbal FROM {supplier}")
def op_x02_union_of_connectors(t: Tables) -> DataFrame:
    return build.union_all(t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("SELECT src, dst FROM {flow} UNION SELECT src, dst FROM {shallow}")
def op_x05_lineage_union(t: Tables) -> DataFrame:
    return build.union_edges(t.flow, t.shallow)


@query("SELECT DISTINCT 'crm' AS connector, c_name AS local_name, 'user:' || c_custkey AS user_name FROM {customer}")
def op_x07_translations(t: Tables) -> DataFrame:
    known = t.customer.select(F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"), F.concat(F.lit("user:"), "c_custkey").alias("user_name"))
    return assemble.translations(known.union(known))


@query("SELECT 'crm' AS connector, c_name AS name FROM {customer}")
def op_p09_connector_subset(t: Tables) -> DataFrame:
    every = t.customer.select(F.lit("crm").alias("connector"), F.col("c_name").alias("name")).union(t.supplier.select(F.lit("dw"), "s_name"))
    return assemble.of_connectors({"users": every}, "crm")["users"]


@query(f"SELECT p_partkey, 'snowflake://acct.snowflakecomputing.com/DB/' || upper({ENC.format('p_type')}) || '/X.' || p_partkey AS relation, 'tableau://site/' || {ENC.format('p_type')} || '/' || {ENC.format('p_name')} || '?type=view' AS view FROM {{part}}".replace("'/X.' || p_partkey", "'/P' || p_partkey"))
def op_f05_cual_builders(t: Tables) -> DataFrame:
    dotted = F.concat(F.lit("db."), "p_type", F.lit(".p"), "p_partkey")
    return t.part.select("p_partkey", cual.relation(F.lit("acct"), dotted).alias("relation"), cual.bi(F.lit("site"), F.array("p_type", "p_name"), F.lit("view")).alias("view"))


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_size > 20 ELSE p_size <= 40 END AS legal FROM {part}")
def op_f10_legal_paths(t: Tables) -> DataFrame:
    size, few = F.col("p_size"), F.col("p_type") == "ECONOMY"
    path = F.when(few & (size > 20), "/*/**").when(few, "**/*").when(size <= 40, "*/*/*").otherwise("/*/x")
    return t.part.select("p_partkey", paths.legal_wildcard(path).alias("legal"))


@query("SELECT p_partkey, p_type || '>' || p_brand AS shown, 'DB,DB.' || p_type || ',DB.' || p_type || '.x' AS prefixes FROM {part}")
def op_f10_paths_shown(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", paths.shown(F.array("p_type", "p_brand"), ">").alias("shown"), F.array_join(paths.prefixes(F.concat(F.lit("DB."), "p_type", F.lit(".x"))), ",").alias("prefixes"))


@query("""SELECT p_partkey, 'DB|' || p_name || '""' AS brackets, 'DB|' || p_name || '""x' AS quoted FROM {part}""")
def op_f13_table_names(t: Tables) -> DataFrame:
    brackets, quoted = F.concat(F.lit("[DB].["), "p_name", F.lit('"]')), F.concat(F.lit('db."'), "p_name", F.lit('""x"'))
    return t.part.select("p_partkey", F.array_join(names.table_parts(brackets), "|").alias("brackets"), F.array_join(names.table_parts(quoted), "|").alias("quoted"))


@query("SELECT p_partkey, 'DB|' || upper(p_name) AS parts FROM {part}")
def op_f14_model_parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(names.model_parts(F.concat(F.lit("db."), "p_name")), "|").alias("parts"))


@query("SELECT event_id, value < 50 AS small FROM {events}")
def op_f19_booleans(t: Tables) -> DataFrame:
    return t.events.select("event_id", names.to_boolean(F.when(F.col("value") < 50, "true").otherwise("false")).alias("small"))


@query("SELECT c_custkey, 'first_name=' || c_name || ';full_name=' || c_name || ' ' || c_mktsegment || ';email=' || c_custkey || '@x;crm=' || c_custkey AS ids FROM {customer} WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'first_name=' || c_name || ';email=' || c_custkey || '@x;crm=' || c_custkey FROM {customer} WHERE NOT c_acctbal > 0")
def op_f22_identifiers(t: Tables) -> DataFrame:
    last, key = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("c_custkey").cast("string")
    found = names.identifiers(F.col("c_name"), F.coalesce(last, F.lit(" ")), F.concat(key, F.lit("@x")), crm=key)
    kept = F.filter(found, lambda x: x["kind"] != "last_name")
    return t.customer.select("c_custkey", F.array_join(F.transform(kept, lambda x: F.concat_ws("=", x["kind"], x["value"])), ";").alias("ids"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'configured' WHEN c_acctbal > 0 THEN c_custkey || '@x' ELSE c_name END AS user_name FROM {customer}")
def op_f23_user_names(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", names.user_name(F.when(b > 5000, "configured"), F.when(b > 0, F.concat(F.col("c_custkey").cast("string"), F.lit("@x"))).otherwise(" "), F.col("c_name")).alias("user_name"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE epoch(o_orderdate)::BIGINT END AS seconds FROM {orders}")
def op_f25_epoch_seconds(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", names.epoch_seconds(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'allow' ELSE 'other' END AS mode, CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END AS detail FROM {events}")
def op_f26_modes(t: Tables) -> DataFrame:
    mode, detail = names.mode_of(F.when(F.col("event_type").isin("view", "click"), "Allow").otherwise(F.col("event_type")))
    return t.events.select("event_id", mode.alias("mode"), detail.alias("detail"))


@query("SELECT p_partkey, p_brand AS short FROM {part}")
def op_f27_short_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.short_name(F.array("p_type", "p_brand")).alias("short"))


@query("""SELECT DISTINCT 'asset' AS src_type, asset AS src_id, 'tag' AS dst_type, tag AS dst_id, 'tagged_as' AS edge_type FROM {applied} UNION SELECT 'tag', tag, 'asset', asset, 'applied_to' FROM {applied}
  UNION SELECT 'asset', asset, 'tag', tag, 'untagged_as' FROM {removed} UNION SELECT 'tag', tag, 'asset', asset, 'removed_from' FROM {removed} UNION SELECT 'asset', src, 'asset', dst, 'parent_of' FROM {shallow}""")
def op_m03_tag_overlay(t: Tables) -> DataFrame:
    edges = t.shallow.select(F.lit("asset").alias("src_type"), F.col("src").alias("src_id"), F.lit("asset").alias("dst_type"), F.col("dst").alias("dst_id"), F.lit("parent_of").alias("edge_type"))
    return state.overlay_tags(edges, t.applied, t.removed)


# Whole graphs, validation and all differences


def parts_of_graph(t: Tables) -> dict[str, DataFrame]:
    mark = lambda m, c: F.concat(F.lit(m), F.col(c))
    one = lambda c: F.array(c)
    users = t.customer.select(mark("user:", "c_custkey").alias("node_id"), one(F.lit("crm")).alias("connectors"), F.array(mark("nations:", "c_nationkey"), F.lit("nobody")).alias("member_of"))
    groups = t.nation.select(mark("nations:", "n_nationkey").alias("node_id"), one(F.lit("crm")).alias("connectors"), F.array().cast("array<string>").alias("member_of"))
    assets = t.hier.where("dst NOT LIKE 'customer:%'").groupBy(F.col("dst").alias("node_id")).agg(F.collect_set("src").alias("child_of")).select("node_id", one(F.lit("dw")).alias("connectors"), "child_of", F.substring_index("node_id", ":", 1).alias("asset_type"))
    policies = t.region.select(mark("p", "r_regionkey").alias("node_id"), one(F.lit("dw")).alias("connectors"), one(mark("region:", "r_regionkey")).alias("governs"), one(mark("nations:", "r_regionkey")).alias("granted_to_groups"), one(F.lit("READ")).alias("privileges"))
    return {"user": users, "group": groups, "asset": assets, "policy": policies}


def assembled(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    defaults = t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("root"), F.lit("/*").alias("path"), F.lit("nation").alias("target_type"), F.lit("group").alias("agent_type"), F.concat(F.lit("nations:"), "r_regionkey").alias("agent"), F.array(F.lit("USE")).alias("privileges"))
    rows = t.perms.withColumn("reasons", F.array().cast("array<string>")).withColumn("mode_detail", F.lit(None).cast("string"))
    return assemble.assemble(parts_of_graph(t), defaults, rows)


DEFAULT_ID = "'group:nations:' || r_regionkey || ' -> region:' || r_regionkey || '//* (nation)'"


@query("SELECT 'user' AS node_type, 'user:' || c_custkey AS node_id FROM {customer} UNION ALL SELECT 'group', 'nations:' || n_nationkey FROM {nation} UNION ALL SELECT DISTINCT 'asset', dst FROM {hier} WHERE dst NOT LIKE 'customer:%' UNION ALL SELECT 'policy', 'p' || r_regionkey FROM {region} UNION ALL SELECT 'default_policy', " + DEFAULT_ID + " FROM {region}")
def op_m01_graph_nodes(t: Tables) -> DataFrame:
    return assembled(t)[0].select("node_type", "node_id")


@query("""WITH e AS (SELECT 'user:' || c_custkey AS src_id, 'nations:' || c_nationkey AS dst_id, 'member_of' AS edge_type FROM {customer} UNION SELECT 'nations:' || c_nationkey, 'user:' || c_custkey, 'includes' FROM {customer}
  UNION SELECT dst, src, 'child_of' FROM {hier} WHERE dst NOT LIKE 'customer:%' AND src <> 'root' UNION SELECT src, dst, 'parent_of' FROM {hier} WHERE dst NOT LIKE 'customer:%' AND src <> 'root'
  UNION SELECT 'p' || r_regionkey, 'region:' || r_regionkey, 'governs' FROM {region} UNION SELECT 'region:' || r_regionkey, 'p' || r_regionkey, 'governed_by' FROM {region}
  UNION SELECT 'p' || r_regionkey, 'nations:' || r_regionkey, 'granted_to' FROM {region} UNION SELECT 'nations:' || r_regionkey, 'p' || r_regionkey, 'granted_from' FROM {region}
  UNION SELECT ID, 'nations:' || r_regionkey, 'granted_to' FROM {region} UNION SELECT 'nations:' || r_regionkey, ID, 'granted_from' FROM {region}
  UNION SELECT ID, 'region:' || r_regionkey, 'provided_default_for_children' FROM {region} UNION SELECT 'region:' || r_regionkey, ID, 'received_childrens_default_from' FROM {region}
  UNION SELECT ID, 'nation:' || n_nationkey, 'governs' FROM {region} JOIN {nation} ON n_regionkey = r_regionkey UNION SELECT 'nation:' || n_nationkey, ID, 'governed_by' FROM {region} JOIN {nation} ON n_regionkey = r_regionkey)
  SELECT * FROM e""".replace("ID,", DEFAULT_ID + ","))
def op_m01_graph_edges(t: Tables) -> DataFrame:
    return assembled(t)[1].select("src_id", "dst_id", "edge_type")


@query("SELECT node_id, string_agg(connector, ',' ORDER BY connector) AS connectors FROM (SELECT 'user:' || c_custkey AS node_id, 'dw' AS connector FROM {customer} UNION SELECT CASE WHEN c_acctbal > 5000 THEN 'person:' || c_nationkey ELSE 'user:' || c_custkey END, 'crm' FROM {customer}) x GROUP BY node_id")
def op_m04_user_nodes(t: Tables) -> DataFrame:
    user = F.concat(F.lit("user:"), "c_custkey")
    nodes = t.customer.select(user.alias("node_id"), F.array(F.lit("crm"), F.lit("dw")).alias("connectors"))
    renames = t.customer.where("c_acctbal > 5000").select(F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"), user.alias("old"), F.concat(F.lit("person:"), "c_nationkey").alias("new"))
    edges = t.customer.select(user.alias("user"), F.lit("g").alias("other"), F.lit("crm").alias("connector"), F.lit("member_of").alias("edge_type"))
    known = t.customer.select(F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"), user.alias("user_name"))
    return assemble.change_identities(nodes, edges, known, renames)[0].select("node_id", joined("connectors"))


@query("""WITH g AS (SELECT CASE WHEN n_regionkey = 0 THEN 'gone::' ELSE '' END || n_name AS name, n_regionkey AS r, n_nationkey AS k FROM {nation})
  SELECT 'group prefix' AS rule, name AS subject, 'no connector gone for the prefix of group ' || name AS message FROM g WHERE r = 0
  UNION ALL SELECT 'unknown parent group', name, 'no group REGION' || r || ' in the configuration' FROM g
  UNION ALL SELECT 'group mapped twice', 'r' || r, 'crm group r' || r || ' has several names' FROM g GROUP BY r HAVING count(*) > 1""")
def op_m06_group_rules(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("n_regionkey") == 0, "gone::").otherwise(""), "n_name")
    groups = t.nation.select(name.alias("name"), F.create_map(F.lit("crm"), F.concat(F.lit("r"), "n_regionkey")).alias("identifiers"), F.array(F.concat(F.lit("REGION"), "n_regionkey")).alias("member_of"))
    return validate.groups(groups, t.spark.createDataFrame([("crm",)], "connector string"))


@query("""WITH u AS (SELECT c_name AS name, 'l' || c_custkey AS local, c_mktsegment AS g, c_acctbal AS b FROM {customer} WHERE c_acctbal < 9000)
  SELECT 'unknown local user' AS rule, name AS subject, 'crm has no user ' || local AS message FROM u WHERE b < 0 UNION ALL SELECT 'unknown group', name, 'no group BUILDING in the configuration' FROM u WHERE g = 'BUILDING'
  UNION ALL SELECT 'user left out', 'l' || c_custkey, 'no configuration for crm user l' || c_custkey FROM {customer} WHERE c_acctbal >= 9000""")
def op_m06_user_rules(t: Tables) -> DataFrame:
    local = F.concat(F.lit("l"), "c_custkey")
    users = t.customer.where("c_acctbal < 9000").select(F.lit("f").alias("file"), F.col("c_name").alias("name"), F.create_map(F.lit("crm"), local).alias("identifiers"), F.array("c_mktsegment").alias("member_of"))
    groups = t.customer.where("c_mktsegment != 'BUILDING'").select(F.col("c_mktsegment").alias("name")).distinct()
    known = t.customer.where("NOT c_acctbal < 0").select(F.lit("crm").alias("connector"), local.alias("local"))
    return validate.users(users, groups, t.spark.createDataFrame([("crm",)], "connector string"), known)


@query("""SELECT DISTINCT 'illegal privilege' AS rule, p_brand AS subject, p_type || ' isn''t known for TABLE' AS message FROM {part} UNION ALL SELECT DISTINCT 'unknown agent', p_brand, 'no user ' || p_name || ' in the configuration' FROM {part} WHERE p_size > 25 AND p_name NOT IN (SELECT p_name FROM {part} WHERE p_size <= 25)
  UNION ALL SELECT DISTINCT 'illegal path', p_brand, 'not a wildcard path: /a' FROM {part}""")
def op_m06_policy_rules(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("root"), F.lit("snowflake").alias("connector"), F.lit("TABLE").alias("target_type"), F.lit("/a").alias("path"), F.lit("user").alias("agent_type"), F.col("p_name").alias("agent"), F.array("p_type", F.lit("SELECT")).alias("privileges"))
    users, none = t.part.where("p_size <= 25").select(F.col("p_name").alias("name")).distinct(), t.part.limit(0).select(F.col("p_name").alias("name"))
    return validate.default_policies(rows, users, none, capabilities.catalogue(t.spark))


@query("""WITH iw AS (SELECT c_name AS l, CASE WHEN c_acctbal > 5000 THEN 'person:' ELSE 'user:' END || c_custkey AS u FROM {customer}), ih AS (SELECT c_name AS l, 'user:' || c_custkey AS u FROM {customer}),
  x AS (SELECT coalesce(iw.u, ih.u) AS u, iw.l AS w, ih.l AS h FROM iw FULL JOIN ih ON iw.u = ih.u)
  SELECT u AS user_name, CASE WHEN h IS NULL THEN 'add' ELSE 'remove' END AS change, coalesce('crm=' || w, '') AS add_ids, coalesce('crm=' || h, '') AS remove_ids FROM x WHERE w IS NULL OR h IS NULL""")
def op_m09_user_diffs(t: Tables) -> DataFrame:
    found = every_diff(t)["users"].where("change IS NOT NULL")
    return found.select("user_name", "change", *[F.array_join(c, ",").alias(c) for c in ("add_ids", "remove_ids")])


def every_diff(t: Tables) -> dict[str, DataFrame]:
    """Well-off customers are renamed in the configuration; nothing else of theirs changes, but regions' groups and policies do."""
    name = lambda new: F.concat(F.when(F.lit(new) & (F.col("c_acctbal") > 5000), "person:").otherwise("user:"), "c_custkey")
    ids = lambda new: t.customer.select(name(new).alias("user_name"), F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"))
    members = lambda new: t.customer.select(name(new).alias("user_name"), F.array("c_mktsegment").alias("groups"))
    held = lambda new: t.customer.select(F.concat(F.lit("nation:"), "c_nationkey").alias("asset"), F.lit("user").alias("agent_type"), name(new).alias("agent"), F.when(F.lit(new) & (F.col("c_acctbal") < 0), F.array(F.lit("OWN"))).otherwise(F.array(F.lit("READ"))).alias("privileges"))
    groups = lambda df: df.select(F.col("r_name").alias("name"), F.array().cast("array<string>").alias("member_of"))
    kept = t.region.select(F.col("r_name").alias("root"), F.lit("/*").alias("path"), F.lit("nation").alias("target_type"), F.lit("group").alias("agent_type"), F.lit("all").alias("agent"), F.array(F.lit("USE")).alias("privileges"), (F.col("r_regionkey") > 1).alias("connector_managed"))
    side = lambda new, g, d: {"identities": ids(new), "memberships": members(new), "groups": g, "policies": held(new), "default_policies": d}
    return assemble.all_diffs(side(True, groups(t.region), kept), side(False, groups(t.region.where("r_regionkey > 2")), kept.where("root != 'ASIA'")))


@query("SELECT 'groups' AS kind, r_name AS subject, 'add' AS change FROM {region} WHERE r_regionkey <= 2 UNION ALL SELECT 'policies', 'user:' || c_custkey, 'modify' FROM {customer} WHERE c_acctbal < 0 UNION ALL SELECT 'default_policies', r_name, CASE WHEN r_name = 'ASIA' THEN 'add' ELSE 'remove' END FROM {region} WHERE r_regionkey <= 1 AND r_name <> 'ASIA' OR r_regionkey > 1 AND r_name = 'ASIA'")
def op_m09_other_diffs(t: Tables) -> DataFrame:
    d = every_diff(t)
    one = lambda kind, c: d[kind].select(F.lit(kind).alias("kind"), F.col(c).alias("subject"), "change")
    return one("groups", "name").union(one("policies", "agent")).union(one("default_policies", "root"))


@query("WITH " + governance.MEMBER + ", " + governance.set_diff("mw", "mh", "user_name", "g") + """, m AS (SELECT * FROM d WHERE change = 'modify')
  SELECT CASE WHEN x < '3' THEN 'crm' ELSE 'dw' END AS connector, user_name, string_agg(x, ',' ORDER BY x) AS to_add FROM (SELECT user_name, unnest(string_split(to_add, ',')) AS x FROM m WHERE to_add <> '') a GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY CASE WHEN x < '3' THEN 'crm' ELSE 'dw' END, user_name"))
def op_a13_users_by_connector(t: Tables) -> DataFrame:
    owned = t.orders.select(F.col("o_orderpriority").alias("group")).distinct().select("group", F.when(F.col("group") < "3", "crm").otherwise("dw").alias("connector"), F.col("group").alias("local"))
    return policy.users_by_connector(governance.memberships(t), owned).where(F.size("to_add") > 0).select("connector", "user_name", joined("to_add"))
