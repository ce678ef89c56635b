"""Permissions, policies, differences, plans and column functions over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cual, names, paths
from ..operators import build, permissions, policy, warehouse
from ..plans import bi_rest, warehouse_sql
from . import graph
from .derived import Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


def state(df: DataFrame, keys: list[str], value: str = "privilege", out: str = "privileges") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(out))


# Node and permission merging

MERGED = """WITH n AS (SELECT concat('key', c_custkey % 200) AS name, c_mktsegment AS segment, c_nationkey AS v, 'crm' AS connector FROM {customer}
  UNION ALL SELECT concat('key', s_suppkey % 200), 'SUPPLIER', s_nationkey, 'dw' FROM {supplier})"""


def merging(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.sql("SELECT concat('key', c_custkey % 200) AS name, c_mktsegment AS segment, c_nationkey AS v, 'crm' AS connector FROM {customer} UNION ALL SELECT concat('key', s_suppkey % 200), 'SUPPLIER', s_nationkey, 'dw' FROM {supplier}")
    nodes = rows.select("name", F.array("connector").alias("connectors"), F.create_map("segment", F.col("v").cast("string")).alias("metadata"))
    return build.merge_nodes(nodes, ["name"], ["connectors"], ["metadata"], [])


@query(MERGED + """, m AS (SELECT name, segment, min(v::VARCHAR) AS v FROM n GROUP BY name, segment)
  SELECT a.name, a.connectors, b.metadata FROM (SELECT name, string_agg(DISTINCT connector, ',' ORDER BY connector) AS connectors FROM n GROUP BY name) a
  JOIN (SELECT name, string_agg(segment || '=' || v, ',' ORDER BY segment) AS metadata FROM m GROUP BY name) b USING (name)""")
def op_a01_node_merge(t: Tables) -> DataFrame:
    entries = F.array_sort(F.map_entries("metadata"))
    return merging(t)[0].select("name", joined("connectors"), F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@query(MERGED + " SELECT name, 'metadata' AS \"column\", segment AS detail, count(DISTINCT v) AS values FROM n GROUP BY name, segment HAVING count(DISTINCT v) > 1")
def op_a01_merge_conflicts(t: Tables) -> DataFrame:
    return merging(t)[1].select("name", "column", "detail", "values")


@query("""WITH t AS (SELECT *, CASE WHEN lag(mode) OVER w = mode THEN 0 ELSE 1 END AS turn FROM {perms} WINDOW w AS (PARTITION BY user_id, asset_id, privilege ORDER BY seq)),
  r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id, asset_id, privilege ORDER BY seq) AS run FROM t),
  l AS (SELECT *, max(run) OVER (PARTITION BY user_id, asset_id, privilege) AS last FROM r)
  SELECT user_id, asset_id, privilege, min(mode) AS mode, string_agg(concat('e', seq), ',' ORDER BY seq) AS reasons FROM l WHERE run = last GROUP BY user_id, asset_id, privilege""")
def op_a02_permission_merge(t: Tables) -> DataFrame:
    rows = t.perms.withColumn("reasons", F.array(F.concat(F.lit("e"), "seq"))).withColumn("mode_detail", F.lit(None).cast("string"))
    return permissions.merge(rows).select("user_id", "asset_id", "privilege", "mode", joined("reasons"))


@query("SELECT user_id, asset_id, privilege, arg_max(mode, seq) AS mode, max(seq) AS seq FROM {perms} GROUP BY user_id, asset_id, privilege")
def op_a03_last_write(t: Tables) -> DataFrame:
    rows = t.perms.withColumn("reasons", F.array().cast("array<string>")).withColumn("mode_detail", F.lit(None).cast("string"))
    return permissions.last_write(rows).select("user_id", "asset_id", "privilege", "mode", "seq")


@query("WITH u AS (SELECT tag, asset FROM {applied} UNION SELECT tag, asset FROM {removed}) SELECT tag, string_agg(asset, ',' ORDER BY asset) AS asset FROM u GROUP BY tag")
def op_a04_union_sets(t: Tables) -> DataFrame:
    return permissions.union_sets(t.applied, t.removed, "tag", "asset").select("tag", joined("asset"))


# Warehouse grants


@query("""WITH g AS (SELECT role, asset, replace(privilege, 'REFERENCE USAGE', 'REFERENCE_USAGE') AS privilege FROM {grants} WHERE kind IN ('TABLE', 'VIEW'))
  SELECT concat_ws('.', 'snowflake', role, asset) AS name, role, asset, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges FROM g GROUP BY role, asset""")
def op_a05_grants_to_policies(t: Tables) -> DataFrame:
    return warehouse.grants_to_policies(t.grants).select("name", "role", "asset", joined("privileges"))


@query("""WITH f AS (SELECT DISTINCT role, CASE WHEN privilege = 'INSERT' THEN split_part(asset, '.', 1) ELSE concat_ws('.', split_part(asset, '.', 1), split_part(asset, '.', 2)) END AS root,
    CASE WHEN privilege = 'INSERT' THEN '/*/*' ELSE '/*' END AS path, kind AS target_type, replace(privilege, 'REFERENCE USAGE', 'REFERENCE_USAGE') AS privilege FROM {grants} WHERE kind IN ('TABLE', 'VIEW'))
  SELECT role, root, path, target_type, string_agg(privilege, ',' ORDER BY privilege) AS privileges FROM f GROUP BY role, root, path, target_type""")
def op_a06_future_grants(t: Tables) -> DataFrame:
    place = F.when(F.col("privilege") == "INSERT", F.substring_index("asset", ".", 1)).otherwise(F.substring_index("asset", ".", 2))
    rows = t.grants.select("role", F.concat(place, F.lit(".<"), "kind", F.lit(">")).alias("name"), F.col("kind").alias("target"), "privilege")
    return warehouse.future_grants_to_defaults(rows).select("role", "root", "path", "target_type", joined("privileges"))


@query("SELECT kind, name, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'ROLE' ELSE 'SHARE' END AS kind, concat('g', c_custkey % 50) AS name, c_mktsegment AS role FROM {customer}) x WHERE kind <> 'SHARE' GROUP BY kind, name")
def op_a07_role_members(t: Tables) -> DataFrame:
    rows = t.sql("SELECT c_mktsegment AS role, CASE c_custkey % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'ROLE' ELSE 'SHARE' END AS granted_to, concat('g', c_custkey % 50) AS grantee FROM {customer}")
    return warehouse.role_members(rows).select("kind", "name", joined("roles"))


INCLUDE = ("DB.ECONOMY*", "DB.STANDARD.Brand#1", "DB.PROMO.Brand#2*")


@query("SELECT DISTINCT concat_ws('.', 'DB', p_type, p_brand) AS name FROM {part} WHERE starts_with(concat('DB.', p_type), 'DB.ECONOMY') OR concat_ws('.', 'DB', p_type, p_brand) = 'DB.STANDARD.Brand#1' OR starts_with(concat_ws('.', 'DB', p_type, p_brand), 'DB.PROMO.Brand#2') UNION SELECT DISTINCT concat('DB.', p_type) FROM {part} WHERE p_type LIKE 'ECONOMY%' OR p_type IN ('STANDARD', 'PROMO') UNION SELECT 'DB'")
def op_p06_include_list(t: Tables) -> DataFrame:
    listed = t.sql("SELECT DISTINCT concat_ws('.', 'DB', p_type, p_brand) AS name FROM {part} UNION SELECT DISTINCT concat('DB.', p_type) FROM {part} UNION SELECT 'DB'")
    patterns = t.spark.createDataFrame([(p,) for p in INCLUDE], "pattern string")
    return warehouse.include(listed, patterns)


# Policies and defaults

EXPANDED = graph.COVERED + """, levels AS (SELECT node AS asset, 'group' AS agent_type, agent, lpad(root_depth::VARCHAR, 3, '0') || replace(replace(replace(path, '**', '1'), '*', '2'), '/', '') AS level, privilege FROM covered),
  lv AS (SELECT asset, agent_type, agent, level, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges, 0 AS explicit FROM levels GROUP BY asset, agent_type, agent, level),
  ex AS (SELECT asset, agent_type, agent, coalesce(string_agg(DISTINCT privilege, ',' ORDER BY privilege), '') AS privileges, coalesce('note=' || max(note), '') AS metadata FROM {explicit_rows} GROUP BY asset, agent_type, agent),
  every AS (SELECT asset, agent_type, agent, level, privileges, '' AS metadata, explicit FROM lv UNION ALL SELECT asset, agent_type, agent, NULL, privileges, metadata, 1 FROM ex),
  won AS (SELECT *, row_number() OVER (PARTITION BY asset, agent_type, agent ORDER BY explicit DESC, level DESC) AS r FROM every)"""


def explicit(t: Tables) -> DataFrame:
    note = F.max("note")
    return t.explicit_rows.groupBy(*policy.AGENT).agg(F.array_sort(F.collect_set("privilege")).alias("privileges"), F.when(note.isNotNull(), F.create_map(F.lit("note"), note)).alias("metadata"))


def expanded_defaults(t: Tables) -> DataFrame:
    return graph.covered(t).select(F.col("node").alias("asset"), F.lit("group").alias("agent_type"), "agent", "root_depth", "path", F.array("privilege").alias("privileges"))


@query(EXPANDED + " SELECT asset, agent, privileges, metadata, level, explicit FROM won WHERE r = 1")
def op_a09_default_priority(t: Tables) -> DataFrame:
    return policy.expand(explicit(t), expanded_defaults(t)).select("asset", "agent", joined("privileges"), flat("metadata"), "level", "explicit")


@query(EXPANDED + """, d AS (SELECT asset, agent_type, agent, privileges, row_number() OVER (PARTITION BY asset, agent_type, agent ORDER BY level DESC) AS r FROM lv),
  g AS (SELECT * FROM d WHERE r = 1)
  SELECT coalesce(ex.asset, g.asset) AS asset, coalesce(ex.agent, g.agent) AS agent, coalesce(ex.privileges, '') AS privileges, coalesce(ex.metadata, '') AS metadata FROM ex FULL JOIN g ON ex.asset = g.asset AND ex.agent_type = g.agent_type AND ex.agent = g.agent
  WHERE ex.asset IS NULL OR g.asset IS NULL OR ex.privileges <> g.privileges OR ex.metadata <> ''""")
def op_m08_compaction(t: Tables) -> DataFrame:
    return policy.compact(explicit(t), expanded_defaults(t)).select("asset", "agent", joined("privileges"), flat("metadata"))


def every_policy(t: Tables) -> DataFrame:
    """The policies of all orders and their lines."""
    named = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return named.select(F.concat(F.lit("customer:"), "o_custkey").alias("asset"), F.lit("user").alias("agent_type"), F.concat(F.lit("user:"), "l_suppkey").alias("agent"), F.col("l_returnflag").alias("privilege"))


FOLD = """WITH p AS (SELECT asset, agent, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges FROM {policies} GROUP BY asset, agent)"""


@query(FOLD + " SELECT asset, privileges, string_agg(agent, ',' ORDER BY agent) AS users, '' AS groups FROM p GROUP BY asset, privileges")
def op_a10_fold_policies(t: Tables) -> DataFrame:
    return policy.fold(state(every_policy(t), policy.AGENT), ["asset"]).select("asset", joined("privileges"), joined("users"), joined("groups"))


@query("SELECT root, path, target_type, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges, 'group:all' AS groups FROM {default_rows} GROUP BY root, path, target_type")
def op_a11_fold_defaults(t: Tables) -> DataFrame:
    rows = state(t.default_rows.withColumn("agent_type", F.lit("group")), policy.DEFAULT)
    return policy.fold(rows, ["root", "path", "target_type"]).select("root", "path", "target_type", joined("privileges"), joined("groups"))


@query("""SELECT user_name, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT concat('user:', c_custkey) AS user_name, concat('crm=', c_name) AS id FROM {customer}
  UNION ALL SELECT concat('user:', s_suppkey), concat('dw=', s_name) FROM {supplier}) x GROUP BY user_name""")
def op_a12_identity_state(t: Tables) -> DataFrame:
    from ..operators import state as S

    names = lambda df, connector, key, name: df.select(F.concat(F.lit("user:"), key).alias("user_name"), F.lit(connector).alias("connector"), F.col(name).alias("local"))
    rows = names(t.customer, "crm", "c_custkey", "c_name").union(names(t.supplier, "dw", "s_suppkey", "s_name"))
    return S.identities(rows).select("user_name", joined("ids"))


@query(graph.COVERED + " SELECT concat_ws('-', c.node, c.agent) AS name, c.node AS asset, c.agent FROM (SELECT DISTINCT node, agent FROM covered) c WHERE NOT EXISTS (SELECT 1 FROM {explicit_rows} x WHERE x.asset = c.node AND x.agent = c.agent)")
def op_j11_non_default_policies(t: Tables) -> DataFrame:
    rows = graph.covered(t).select(F.col("node").alias("asset"), "agent")
    return policy.non_default_policies(rows, t.explicit_rows).select("name", "asset", "agent")


# Differences


def set_diff(wanted: str, have: str, keys: str, value: str, where: str = "") -> str:
    return f"""w AS (SELECT {keys}, list(DISTINCT {value}) AS v FROM {wanted} GROUP BY {keys}), h AS (SELECT {keys}, list(DISTINCT {value}) AS v FROM {have} GROUP BY {keys}),
  x AS (SELECT {keys}, CASE WHEN h.v IS NULL THEN 'add' WHEN w.v IS NULL THEN 'remove' ELSE 'modify' END AS change,
    array_to_string(list_sort(list_filter(coalesce(w.v, []), lambda p: NOT list_contains(coalesce(h.v, []), p))), ',') AS to_add,
    array_to_string(list_sort(list_filter(coalesce(h.v, []), lambda p: NOT list_contains(coalesce(w.v, []), p))), ',') AS to_remove FROM w FULL JOIN h USING ({keys})),
  d AS (SELECT * FROM x WHERE change <> 'modify' OR to_add <> '' OR to_remove <> '')"""


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in ("to_add", "to_remove")})


POLICIES = """WITH w AS (SELECT asset, agent_type, agent, list(DISTINCT privilege) AS v, 'status=' || max(status) AS m FROM {config_policy} GROUP BY asset, agent_type, agent),
  h AS (SELECT asset, agent_type, agent, list(DISTINCT privilege) AS v, 'status=' || max(status) AS m FROM {env_policy} GROUP BY asset, agent_type, agent),
  x AS (SELECT asset, agent_type, agent, CASE WHEN h.v IS NULL THEN 'add' WHEN w.v IS NULL THEN 'remove' ELSE 'modify' END AS change,
    array_to_string(list_sort(list_filter(coalesce(w.v, []), lambda p: NOT list_contains(coalesce(h.v, []), p))), ',') AS to_add,
    array_to_string(list_sort(list_filter(coalesce(h.v, []), lambda p: NOT list_contains(coalesce(w.v, []), p))), ',') AS to_remove,
    CASE WHEN w.m IS DISTINCT FROM h.m THEN coalesce(w.m, '') ELSE '' END AS add_metadata, CASE WHEN w.m IS DISTINCT FROM h.m THEN coalesce(h.m, '') ELSE '' END AS remove_metadata FROM w FULL JOIN h USING (asset, agent_type, agent)),
  d AS (SELECT * FROM x WHERE change <> 'modify' OR to_add <> '' OR to_remove <> '' OR add_metadata <> '' OR remove_metadata <> '')"""


def with_status(df: DataFrame) -> DataFrame:
    return df.groupBy(*policy.AGENT).agg(F.array_sort(F.collect_set("privilege")).alias("privileges"), F.create_map(F.lit("status"), F.max("status")).alias("metadata"))


def flat(metadata: str) -> F.Column:
    return F.array_join(F.transform(policy.entries(metadata), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(metadata)


@query(POLICIES + " SELECT * FROM d")
def op_j14_policy_diff(t: Tables) -> DataFrame:
    return shown(policies_diff(t)).withColumns({c: flat(c) for c in ("add_metadata", "remove_metadata")})


def policies_diff(t: Tables) -> DataFrame:
    return policy.policy_diff(with_status(t.config_policy), with_status(t.env_policy))


@query("""WITH p AS (SELECT asset, agent, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges, 'status=' || max(status) AS metadata FROM {config_policy} GROUP BY asset, agent)
  SELECT asset, privileges, metadata, string_agg(agent, ',' ORDER BY agent) AS users FROM p GROUP BY asset, privileges, metadata""")
def op_a10_fold_metadata(t: Tables) -> DataFrame:
    return policy.fold(with_status(t.config_policy), ["asset"]).select("asset", joined("privileges"), flat("metadata"), joined("users"))


DEFAULTS = """dw AS (SELECT *, root_depth = 2 AS managed FROM {default_rows} WHERE path <> '/*/*'), dh AS (SELECT root, root_depth, path, target_type, agent, CASE privilege WHEN 'READ' THEN 'WRITE' ELSE privilege END AS privilege, path = '/**' AS managed FROM {default_rows} WHERE root NOT LIKE 'region:4'),
  w AS (SELECT root, path, target_type, agent, min(privilege) AS v, bool_or(managed) AS m, 'level=' || min(root_depth) AS n FROM dw GROUP BY ALL), h AS (SELECT root, path, target_type, agent, min(privilege) AS v, bool_or(managed) AS m, 'level=1' AS n FROM dh GROUP BY ALL)"""


def default_diff(t: Tables) -> DataFrame:
    wanted = t.default_rows.where("path != '/*/*'").select("*", (F.col("root_depth") == 2).alias("connector_managed"))
    have = t.default_rows.where("root != 'region:4'").withColumn("privilege", F.when(F.col("privilege") == "READ", "WRITE").otherwise(F.col("privilege"))).select("*", (F.col("path") == "/**").alias("connector_managed"))
    level = lambda df: F.create_map(F.lit("level"), F.min("root_depth").cast("string") if df is wanted else F.lit("1"))
    one = lambda df: df.withColumn("agent_type", F.lit("group")).groupBy(*policy.DEFAULT, "connector_managed").agg(F.array_sort(F.collect_set("privilege")).alias("privileges"), level(df).alias("metadata"))
    return policy.default_policy_diff(one(wanted), one(have))


@query("WITH " + DEFAULTS.replace("GROUP BY ALL", "GROUP BY root, path, target_type, agent") + """ SELECT root, path, target_type, agent, CASE WHEN h.v IS NULL THEN 'add' WHEN w.v IS NULL THEN 'remove' ELSE 'modify' END AS change,
  CASE WHEN w.v IS DISTINCT FROM h.v THEN coalesce(w.v, '') ELSE '' END AS to_add, CASE WHEN w.v IS DISTINCT FROM h.v THEN coalesce(h.v, '') ELSE '' END AS to_remove,
  CASE WHEN w.n IS DISTINCT FROM h.n THEN coalesce(w.n, '') ELSE '' END AS add_metadata, CASE WHEN w.n IS DISTINCT FROM h.n THEN coalesce(h.n, '') ELSE '' END AS remove_metadata,
  CASE WHEN w.m IS DISTINCT FROM h.m THEN coalesce(w.m, false) END AS connector_managed FROM w FULL JOIN h USING (root, path, target_type, agent) WHERE w.v IS DISTINCT FROM h.v OR w.m IS DISTINCT FROM h.m OR w.n IS DISTINCT FROM h.n""")
def op_j15_default_policy_diff(t: Tables) -> DataFrame:
    return shown(default_diff(t)).withColumns({c: flat(c) for c in ("add_metadata", "remove_metadata")}).drop("agent_type")


GROUPS = """gw AS (SELECT concat('nations:', c_nationkey) AS name, c_mktsegment AS g FROM {customer} WHERE c_acctbal < 7000 AND c_nationkey < 20), gh AS (SELECT concat('nations:', c_nationkey) AS name, c_mktsegment AS g FROM {customer} WHERE c_acctbal > 5000 AND c_nationkey > 4)"""


def groups_diff(t: Tables) -> DataFrame:
    rows = lambda where: state(t.customer.where(where).select(F.concat(F.lit("nations:"), "c_nationkey").alias("name"), F.col("c_mktsegment").alias("g")), ["name"], "g", "member_of")
    return policy.group_diff(rows("c_acctbal < 7000 AND c_nationkey < 20"), rows("c_acctbal > 5000 AND c_nationkey > 4"))


@query("WITH " + GROUPS + ", " + set_diff("gw", "gh", "name", "g") + " SELECT name, change, to_add, CASE WHEN change = 'remove' THEN '' ELSE to_remove END AS to_remove FROM d")
def op_j16_group_diff(t: Tables) -> DataFrame:
    return shown(groups_diff(t))


IDENTITY = """iw AS (SELECT concat('user:', c_custkey) AS user_name, concat('crm=', c_name) AS id FROM {customer} WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT concat('user:', s_suppkey), concat('dw=', s_name) FROM {supplier}),
  ih AS (SELECT concat('user:', c_custkey) AS user_name, concat('crm=', c_name) AS id FROM {customer} WHERE c_mktsegment <> 'MACHINERY')"""


@query("WITH " + IDENTITY + ", " + set_diff("iw", "ih", "user_name", "id") + " SELECT * FROM d")
def op_j17_identity_diff(t: Tables) -> DataFrame:
    return shown(identities_diff(t))


def identities_diff(t: Tables) -> DataFrame:
    crm = lambda skip: t.customer.where(F.col("c_mktsegment") != skip).select(F.concat(F.lit("user:"), "c_custkey").alias("user_name"), F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"))
    dw = t.supplier.select(F.concat(F.lit("user:"), "s_suppkey").alias("user_name"), F.lit("dw").alias("connector"), F.col("s_name").alias("local_name"))
    return policy.identity_diff(crm("BUILDING").unionByName(dw), crm("MACHINERY"))


MEMBER = """mw AS (SELECT concat('user:', o_custkey) AS user_name, o_orderpriority AS g FROM {orders} WHERE o_orderstatus <> 'P'), mh AS (SELECT concat('user:', o_custkey) AS user_name, o_orderpriority AS g FROM {orders} WHERE o_orderstatus <> 'F')"""


def memberships(t: Tables) -> DataFrame:
    rows = lambda skip: state(t.orders.where(F.col("o_orderstatus") != skip).select(F.concat(F.lit("user:"), "o_custkey").alias("user_name"), F.col("o_orderpriority").alias("g")), ["user_name"], "g", "groups")
    return policy.membership_diff(rows("P"), rows("F"))


@query("WITH " + MEMBER + ", " + set_diff("mw", "mh", "user_name", "g") + " SELECT user_name, to_add, to_remove FROM d WHERE change = 'modify'")
def op_j18_membership_diff(t: Tables) -> DataFrame:
    return shown(memberships(t))


@query("WITH " + IDENTITY + ", " + set_diff("iw", "ih", "user_name", "id") + ", id_d AS (SELECT * FROM d), m AS (SELECT user_name, g FROM mw), " + MEMBER.replace("mw AS", "mw AS", 1) + """, mm AS (SELECT user_name, list(DISTINCT g) AS v FROM mw GROUP BY user_name), mn AS (SELECT user_name, list(DISTINCT g) AS v FROM mh GROUP BY user_name),
  md AS (SELECT user_name, array_to_string(list_sort(list_filter(mm.v, lambda p: NOT list_contains(mn.v, p))), ',') AS add_groups, array_to_string(list_sort(list_filter(mn.v, lambda p: NOT list_contains(mm.v, p))), ',') AS remove_groups FROM mm JOIN mn USING (user_name))
  SELECT user_name, change, to_add AS add_ids, to_remove AS remove_ids, add_groups, remove_groups FROM id_d FULL JOIN (SELECT * FROM md WHERE add_groups <> '' OR remove_groups <> '') q USING (user_name)""")
def op_j19_user_diff(t: Tables) -> DataFrame:
    return policy.user_diff(identities_diff(t), memberships(t)).withColumns({c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")) for c in ("add_ids", "remove_ids", "add_groups", "remove_groups")})


SQL["op_j19_user_diff"] = SQL["op_j19_user_diff"].replace("m AS (SELECT user_name, g FROM mw), ", "")


@query("""WITH g AS (SELECT DISTINCT CASE WHEN n_nationkey % 4 = 0 THEN concat('crm::', n_name) ELSE n_name END AS grp FROM {nation}), c AS (SELECT 'crm' AS connector UNION ALL SELECT 'dw')
  SELECT grp AS "group", 'crm' AS connector, substr(grp, 6) AS local FROM g WHERE contains(grp, '::') UNION ALL SELECT grp, connector, CASE WHEN connector = 'dw' AND grp LIKE '%1' THEN concat('dw_', grp) ELSE grp END FROM g, c WHERE NOT contains(grp, '::')""")
def op_j20_group_names(t: Tables) -> DataFrame:
    groups = t.sql("SELECT DISTINCT CASE WHEN n_nationkey % 4 = 0 THEN concat('crm::', n_name) ELSE n_name END AS group FROM {nation}")
    connectors = t.spark.createDataFrame([("crm",), ("dw",)], "connector string")
    overrides = t.nation.where("n_name LIKE '%1'").select(F.col("n_name").alias("group"), F.lit("dw").alias("connector"), F.concat(F.lit("dw_"), "n_name").alias("local"))
    return policy.group_names(groups, connectors, overrides)


# Mutation and validation


@query("""WITH r AS (SELECT concat('user:', c_custkey) AS old, 'crm' AS connector, concat('person:', c_custkey % 100) AS new FROM {customer} WHERE c_custkey % 3 = 0),
  e AS (SELECT src AS user, dst AS other, CASE WHEN dst LIKE 'segment:%' THEN 'crm' ELSE 'dw' END AS connector FROM {members} WHERE src LIKE 'user:%')
  SELECT DISTINCT coalesce(r.new, e.user) AS user, e.other, e.connector FROM e LEFT JOIN r ON r.old = e.user AND r.connector = e.connector""")
def op_m04_identity_remap(t: Tables) -> DataFrame:
    edges = t.members.where("src LIKE 'user:%'").select(F.col("src").alias("user"), F.col("dst").alias("other"), F.when(F.startswith("dst", F.lit("segment:")), "crm").otherwise("dw").alias("connector"), F.lit("member_of").alias("edge_type"))
    renames = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("user:"), "c_custkey").alias("old"), F.lit("crm").alias("connector"), F.concat(F.lit("person:"), F.col("c_custkey") % 100).alias("new"))
    return build.redirect_edges(edges, renames).select("user", "other", "connector")


@query("SELECT 'crm' AS connector, c_name AS local_name, CASE WHEN c_custkey % 3 = 0 THEN concat('person:', c_custkey % 100) ELSE concat('user:', c_custkey) END AS user_name FROM {customer}")
def op_m05_remap_identities(t: Tables) -> DataFrame:
    known = t.customer.select(F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"), F.concat(F.lit("user:"), "c_custkey").alias("user_name"))
    renames = t.customer.where("c_custkey % 3 = 0").select(F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"), F.concat(F.lit("person:"), F.col("c_custkey") % 100).alias("new"))
    return build.remap_identities(known, renames)


@query("""SELECT 'unknown user' AS rule, cast(x AS VARCHAR) AS subject, 'orders name a customer that is not there' AS message FROM (SELECT DISTINCT o_custkey + 7 AS x FROM {orders} EXCEPT SELECT c_custkey FROM {customer}) a
  UNION ALL SELECT 'name used twice', p_name, 'a name must be unique' FROM {part} GROUP BY p_name HAVING count(*) > 1
  UNION ALL SELECT 'not consistent', p_type, 'all parts of a type must have one size' FROM {part} GROUP BY p_type HAVING count(DISTINCT p_size) > 1""")
def op_m06_violations(t: Tables) -> DataFrame:
    shifted = t.orders.select((F.col("o_custkey") + 7).alias("o_custkey"))
    return policy.violations(
        ("unknown user", policy.unknown(shifted, "o_custkey", t.customer, "c_custkey"), "o_custkey", "orders name a customer that is not there"),
        ("name used twice", policy.repeated(t.part, "p_name"), "p_name", "a name must be unique"),
        ("not consistent", policy.inconsistent(t.part, ["p_type"], "p_size"), "p_type", "all parts of a type must have one size"),
    )


ORDERED = """WITH f AS (SELECT o_orderpriority AS file, concat('customer:', o_custkey) AS asset, o_orderkey AS seq, o_orderstatus AS p, CAST(o_orderdate AS VARCHAR) AS d FROM {orders})"""
LAST = ORDERED + ", l AS (SELECT file, asset, max(seq) AS seq, arg_max(p, seq) AS p, arg_max(d, seq) AS d FROM f GROUP BY file, asset)"
#: Metadata of a row, from an entry that all have and one that its status names; then merged key by key.
MERGING = """, e AS (SELECT asset, 'date' AS k, d AS v, seq FROM {} UNION ALL SELECT asset, concat('status ', p), file, seq FROM {}),
  m AS (SELECT asset, string_agg(k || '=' || v, ',' ORDER BY k) AS metadata FROM (SELECT asset, k, arg_min(v, seq) AS v FROM e GROUP BY asset, k) GROUP BY asset)
  SELECT asset, string_agg(DISTINCT p, ',' ORDER BY p) AS privileges, any_value(metadata) AS metadata FROM {} JOIN m USING (asset) GROUP BY asset"""


def in_files(t: Tables) -> DataFrame:
    metadata = F.create_map(F.lit("date"), F.col("o_orderdate").cast("string"), F.concat(F.lit("status "), "o_orderstatus"), F.col("o_orderpriority"))
    rows = t.orders.select(F.col("o_orderpriority").alias("file"), F.concat(F.lit("customer:"), "o_custkey").alias("asset"), F.array("o_orderstatus").alias("privileges"), F.col("o_orderkey").alias("seq"), metadata.alias("metadata"))
    return rows.withColumns({"agent_type": F.lit("user"), "agent": F.lit("u")})


@query(LAST + MERGING.replace("{}", "l"))
def op_m07_last_in_file(t: Tables) -> DataFrame:
    return policy.last_in_file(in_files(t)).select("asset", joined("privileges"), flat("metadata"))


@query(ORDERED + MERGING.replace("{}", "f"))
def op_a08_combined_policies(t: Tables) -> DataFrame:
    return policy.combine(in_files(t)).select("asset", joined("privileges"), flat("metadata"))


@query(ORDERED + """, e AS (SELECT asset, 'date' AS k, d AS v, seq FROM f UNION ALL SELECT asset, concat('status ', p), file, seq FROM f), c AS (SELECT asset, k, arg_min(v, seq) AS kept, list_sort(list_distinct(list(v))) AS vs FROM e GROUP BY asset, k)
  SELECT asset, k AS "key", kept, array_to_string(list_filter(vs, lambda v: v <> kept), ',') AS given_up FROM c WHERE len(vs) > 1""")
def op_a08_metadata_conflicts(t: Tables) -> DataFrame:
    return policy.metadata_conflicts(in_files(t)).select("asset", "key", "kept", joined("given_up"))


@query(FOLD + """, f AS (SELECT asset, privileges, list(CASE WHEN agent = 'user:1' THEN 'user:2' ELSE agent END) AS us FROM p GROUP BY asset, privileges)
  SELECT asset, privileges, array_to_string(list_sort(list_filter(list_distinct(us), lambda u: u <> 'user:3')), ',') AS users FROM f WHERE len(list_filter(us, lambda u: u <> 'user:3')) > 0""")
def op_m13_rename_remove(t: Tables) -> DataFrame:
    folded = policy.fold(state(every_policy(t), policy.AGENT), ["asset"])
    return policy.remove_agent(policy.rename_agent(folded, "users", "user:1", "user:2"), "users", "user:3").select("asset", joined("privileges"), joined("users"))


# Plans

Q = "'\"' || {} || '\"'"


@query("WITH " + GROUPS + ", " + set_diff("gw", "gh", "name", "g") + """, s AS (SELECT 0 AS stage, 'GRANT OWNERSHIP ON ROLE "' || name || '" TO "ADMIN";' AS statement FROM d WHERE change = 'remove'
  UNION ALL SELECT 1, 'CREATE ROLE "' || name || '";' FROM d WHERE change = 'add' UNION ALL SELECT 1, 'DROP ROLE "' || name || '";' FROM d WHERE change = 'remove'
  UNION ALL SELECT 2, 'GRANT ROLE "' || x || '" TO ROLE "' || name || '";' FROM (SELECT name, unnest(string_split(to_add, ',')) AS x FROM d WHERE change <> 'remove' AND to_add <> '') a
  UNION ALL SELECT 2, 'REVOKE ROLE "' || x || '" FROM ROLE "' || name || '";' FROM (SELECT name, unnest(string_split(to_remove, ',')) AS x FROM d WHERE change = 'modify' AND to_remove <> '') a)
  SELECT stage, row_number() OVER (PARTITION BY stage ORDER BY statement) AS seq, statement FROM s""")
def op_m10_plan_sql(t: Tables) -> DataFrame:
    return warehouse_sql.ordered(warehouse_sql.groups(groups_diff(t), "ADMIN"))


@query(POLICIES + """, s AS (SELECT 'GRANT ' || replace(to_add, ',', ', ') || ' ON TABLE ' || asset || ' TO USER "' || agent || '";' AS statement FROM d WHERE change <> 'remove' AND to_add <> ''
  UNION ALL SELECT 'REVOKE ALL ON TABLE ' || asset || ' FROM USER "' || agent || '";' FROM d WHERE change = 'remove'
  UNION ALL SELECT 'REVOKE ' || replace(to_remove, ',', ', ') || ' ON TABLE ' || asset || ' FROM USER "' || agent || '";' FROM d WHERE change = 'modify' AND to_remove <> '') SELECT 2 AS stage, statement FROM s""")
def op_m10_plan_policies(t: Tables) -> DataFrame:
    return warehouse_sql.policies(policies_diff(t).withColumn("asset_kind", F.lit("TABLE")))


@query("WITH " + MEMBER + ", " + set_diff("mw", "mh", "user_name", "g") + """, m AS (SELECT * FROM d WHERE change = 'modify'), a AS (SELECT user_name, unnest(string_split(to_add, ',')) AS x FROM m WHERE to_add <> ''), r AS (SELECT user_name, unnest(string_split(to_remove, ',')) AS x FROM m WHERE to_remove <> '')
  SELECT 1 AS stage, 'POST' AS method, 'groups/' || CASE WHEN x = '1-URGENT' THEN 'id1' ELSE 'group_id_for_new_group_' || x END || '/users' AS url, '{"user":{"id":"' || user_name || '"}}' AS body FROM a
  UNION ALL SELECT 1, 'DELETE', 'groups/' || CASE WHEN x = '1-URGENT' THEN 'id1' ELSE 'group_id_for_new_group_' || x END || '/users/' || user_name, NULL FROM r""")
def op_m11_plan_rest(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([("1-URGENT", "id1")], "name string, id string")
    return bi_rest.memberships(memberships(t), ids)


# Column functions


@query("""SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '^([^/]*//[^/]*)', 1) AS prefix, array_to_string(list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*/?([^?#]*)', 1), '/'), lambda s: s <> ''), '|') AS segments, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS kind FROM {pages}""")
def op_f01_cual_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    typed = F.replace(u, F.lit("page="), F.lit("type="))
    return t.pages.select("page_id", cual.scheme(u).alias("scheme"), cual.prefix(u).alias("prefix"), F.array_join(cual.segments(u), "|").alias("segments"), cual.asset_type(typed).alias("kind"))


@query("SELECT p_partkey, array_to_string(['db', replace(p_name, ' ', '+'), p_name], '|') AS path FROM {part}")
def op_f03_path_decode(t: Tables) -> DataFrame:
    c = F.concat(F.lit("snowflake://a.b/db/"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("%20")))
    return t.part.select("p_partkey", F.array_join(cual.path(c), "|").alias("path"))


@query("SELECT p_partkey, 'dw://host/' || replace(replace(p_brand, '#', '%23'), ' ', '%20') || '/' || replace(p_name, ' ', '%20') || '?type=' || p_type AS cual FROM {part}")
def op_f04_build_cual(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", cual.build(F.lit("dw://host"), F.array("p_brand", "p_name"), F.col("p_type")).alias("cual"))


@query("""WITH h AS (SELECT n_name, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(n_name)) AS d FROM {nation})
  SELECT n_name, concat_ws('-', d[1:8], d[9:12], '5' || d[14:16], ['8', '9', 'a', 'b'][((instr('0123456789abcdef', d[17]) - 1) & 3) + 1] || d[18:20], d[21:32]) AS id FROM h""")
def op_f06_uuid5(t: Tables) -> DataFrame:
    return t.nation.select("n_name", names.uuid5(F.col("n_name")).alias("id"))


@query("SELECT p_partkey, concat('dw::', p_type, '/', p_brand, ' (', p_name, ')') AS asset, concat('dw::', p_brand) AS grp FROM {part}")
def op_f07_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.asset_name(F.lit("dw"), F.array("p_type", "p_brand"), F.col("p_name")).alias("asset"), names.group_name(F.lit("dw"), F.col("p_brand")).alias("grp"))


@query("SELECT p_partkey, concat('DB|DB/', p_type, '|DB/', p_type, '/', p_brand) AS ancestors FROM {part}")
def op_f08_ancestors(t: Tables) -> DataFrame:
    found = paths.ancestors(F.array(F.lit("DB"), "p_type", "p_brand"))
    return t.part.select("p_partkey", F.array_join(F.transform(found, lambda p: F.array_join(p, "/")), "|").alias("ancestors"))


WILD = ("**", "/*", "*/**", "*/*", "*/*/*/*/*", "/*/a", "/**/*")


@query("""WITH v AS (SELECT unnest(['**', '/*', '*/**', '*/*', '*/*/*/*/*', '/*/a', '/**/*']) AS path), s AS (SELECT path, string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') AS p FROM v)
  SELECT path, n_nationkey AS k, len(p)::INTEGER AS depth, p[-1] = '**' AS endless, path NOT IN ('/*/a', '/**/*') AS legal, lpad((n_nationkey % 4)::VARCHAR, 3, '0') || replace(replace(replace(path, '**', '1'), '*', '2'), '/', '') AS priority FROM s, {nation}""")
def op_f11_priority(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(w,) for w in WILD], "path string").join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("k"))))  # 25 nations
    depth, endless = paths.wildcard(F.col("path"))
    return rows.select("path", "k", depth.alias("depth"), endless.alias("endless"), paths.legal_wildcard(F.col("path")).alias("legal"), paths.priority(F.col("k") % 4, F.col("path")).alias("priority"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS stored, '"' || p_brand || '"."' || replace(p_name, 'i', '""') || '"' AS quoted, upper(p_name) || '|x.y' AS parts FROM {part}""")
def op_f12_quotes(t: Tables) -> DataFrame:
    written = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    dotted = F.concat("p_name", F.lit('."x.y"'))
    return t.part.select("p_partkey", names.identifier(written).alias("stored"), names.quoted(F.col("p_brand"), F.replace("p_name", F.lit("i"), F.lit('"'))).alias("quoted"), F.array_join(names.table_parts(dotted), "|").alias("parts"))


@query("SELECT event_id, CASE WHEN value < 50 THEN 'Allow' ELSE 'Deny' END AS mode, event_type AS capability, CASE WHEN event_type IN ('view', 'click') THEN 'allow' ELSE 'other' END AS parsed FROM {events}")
def op_f17_mode_split(t: Tables) -> DataFrame:
    mode, capability = names.split_capability(F.concat(F.when(F.col("value") < 50, "Allow").otherwise("Deny"), "event_type"))
    parsed, _ = names.mode_of(F.when(F.col("event_type").isin("view", "click"), "ALLOW").otherwise(F.col("event_type")))
    return t.events.select("event_id", mode.alias("mode"), capability.alias("capability"), parsed.alias("parsed"))


@query("SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM {events}")
def op_f18_json_get(t: Tables) -> DataFrame:
    return t.events.select("event_id", names.json_get(F.col("props"), "k").alias("k"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'crm' END AS connector, c_name AS local, replace(c_name, '#', '#') AS file FROM {customer}")
def op_f20_names(t: Tables) -> DataFrame:
    written = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("crm::"), "c_name")).otherwise(F.col("c_name"))
    connector, local = names.split_group(written)
    return t.customer.select("c_custkey", connector.alias("connector"), local.alias("local"), names.clean_file_name(F.col("c_name")).alias("file"))


# Streaming


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM {events} GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def op_w01_config_stream(t: Tables) -> DataFrame:
    from ..streaming.watch import Watcher

    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    changes = stream.select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("deleted"))
    watcher = Watcher(t.spark, "user_id", "event_id")
    watcher.start(changes).awaitTermination()
    return watcher.state().select("user_id", "event_id", "event_type")


# Names, observed state and checks


@query("SELECT c_custkey, concat('user:', c_custkey) AS user_name FROM {customer} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM {customer} WHERE c_custkey % 2 <> 0")
def op_j01_global_names(t: Tables) -> DataFrame:
    known = t.customer.where("c_custkey % 2 = 0").select(F.lit("crm").alias("connector"), F.col("c_name").alias("local_name"), F.concat(F.lit("user:"), "c_custkey").alias("user_name"))
    return build.global_names(t.customer.select("c_custkey", F.lit("crm").alias("connector"), F.col("c_name").alias("local_name")), known).select("c_custkey", "user_name")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END AS connector FROM {pages}")
def op_j02_prefix_resolution(t: Tables) -> DataFrame:
    spaces = t.pages.select(cual.prefix(F.col("url")).alias("prefix")).distinct().withColumn("connector", F.when(F.startswith("prefix", F.lit("https")), "secure").otherwise("plain"))
    return build.resolve_prefix(t.pages.select("page_id", F.col("url").alias("cual")), spaces).select("page_id", "connector")


@query("SELECT concat('user:', c_custkey) AS user_id, concat('nation:', c_nationkey) AS asset_id FROM {customer} WHERE c_nationkey < 20")
def op_j05_permissions_by_id(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_name").alias("name"), F.concat(F.lit("user:"), "c_custkey").alias("node_id"))
    assets = t.nation.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), "n_nationkey").alias("node_id"))
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("user"), F.col("n_name").alias("asset"))
    return permissions.by_id(named, users, assets)


POLICY_GRAPH = """WITH g AS (SELECT concat('policy:', c_custkey % 300) AS p, concat('user:', c_custkey) AS agent, concat('nation:', c_nationkey) AS asset FROM {customer})"""


@query(POLICY_GRAPH + " SELECT a.asset, g.agent, string_agg(DISTINCT g.p, ',' ORDER BY g.p) AS privileges, 'from=' || min(g.p) AS metadata FROM (SELECT DISTINCT p, asset FROM g) a JOIN g ON g.p = a.p GROUP BY a.asset, g.agent")
def op_j12_observed_policies(t: Tables) -> DataFrame:
    from ..operators import state as S

    rows = t.customer.select(F.concat(F.lit("policy:"), F.col("c_custkey") % 300).alias("p"), F.concat(F.lit("user:"), "c_custkey").alias("agent"), F.concat(F.lit("nation:"), "c_nationkey").alias("asset"))
    edge = lambda kind, c, name: rows.select(F.lit("policy").alias("src_type"), F.col("p").alias("src_id"), F.lit(kind).alias("dst_type"), F.col(c).alias("dst_id"), F.lit(name).alias("edge_type"))
    nodes = rows.select(F.lit("policy").alias("node_type"), F.col("p").alias("node_id"), F.array("p").alias("privileges")).distinct()
    nodes = nodes.withColumn("metadata", F.create_map(F.lit("from"), "node_id"))
    found = S.observed_policies(nodes, edge("user", "agent", "granted_to").union(edge("asset", "asset", "governs")))
    return found.select("asset", "agent", joined("privileges"), flat("metadata"))


@query("SELECT concat('user:', c.c_custkey) AS name, coalesce(string_agg(DISTINCT o.o_orderpriority, ',' ORDER BY o.o_orderpriority), '') AS groups FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey")
def op_j28_observed_memberships(t: Tables) -> DataFrame:
    from ..operators import state as S

    edges = t.orders.where("o_orderstatus = 'F'").select(F.lit("user").alias("src_type"), F.concat(F.lit("user:"), "o_custkey").alias("src_id"), F.lit("group").alias("dst_type"), F.col("o_orderpriority").alias("dst_id"), F.lit("member_of").alias("edge_type"))
    return S.observed_memberships(t.customer.select(F.concat(F.lit("user:"), "c_custkey").alias("name")), edges).select("name", joined("groups"))


@query("WITH RECURSIVE g AS (SELECT src AS grp, dst AS parent FROM {members} WHERE src NOT LIKE 'user:%'), w(grp, ancestor) AS (SELECT grp, grp FROM g UNION SELECT w.grp, g.parent FROM w JOIN g ON g.grp = w.ancestor) SELECT grp AS \"group\", ancestor FROM w")
def op_t21_nested_groups(t: Tables) -> DataFrame:
    from ..operators import state as S

    return S.expand_nested(t.members.where("src NOT LIKE 'user:%'").select(F.col("src").alias("group"), F.col("dst").alias("parent")))


@query("SELECT src AS parent, dst AS child FROM {shallow}")
def op_a18_children(t: Tables) -> DataFrame:
    assets = t.shallow.groupBy(F.col("dst").alias("asset")).agg(F.collect_set("src").alias("child_of")).withColumn("kind", F.lit("asset"))
    return warehouse.children(assets).select("parent", "child")


@query("SELECT p_brand AS root, count(DISTINCT p_type) AS values FROM {part} WHERE p_size < 10 GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def op_m12_content_permissions(t: Tables) -> DataFrame:
    from ..operators import state as S

    return S.content_permission_conflicts(t.part.select(F.col("p_brand").alias("root"), F.when(F.col("p_size") < 10, "project").otherwise("view").alias("target_type"), F.col("p_type").alias("content_permissions")))


@query("SELECT asset, privilege FROM {grants} WHERE kind IN ('TABLE', 'VIEW') AND privilege NOT IN ('SELECT', 'INSERT') GROUP BY asset, privilege")
def op_a17_illegal_privileges(t: Tables) -> DataFrame:
    from .. import capabilities
    from ..operators import state as S

    rows = t.grants.where("kind IN ('TABLE', 'VIEW')").select("asset", F.lit("snowflake").alias("connector"), F.col("kind").alias("asset_type"), F.array("privilege").alias("privileges"))
    return S.illegal_privileges(rows, capabilities.catalogue(t.spark))


@query("SELECT concat_ws('.', 'DB', p_type, p_brand) AS asset, 'TABLE' AS kind, concat('DB.', p_type) AS parent FROM {part} GROUP BY p_type, p_brand UNION ALL SELECT concat('DB.', p_type), 'SCHEMA', 'DB' FROM {part} GROUP BY p_type UNION ALL SELECT 'DB', 'DATABASE', NULL")
def op_m15_warehouse_assets(t: Tables) -> DataFrame:
    rows = t.sql("SELECT DISTINCT 'DB' AS database, p_type AS schema, p_brand AS name, 'TABLE' AS kind FROM {part} UNION ALL SELECT DISTINCT 'DB', p_type, NULL, 'SCHEMA' FROM {part} UNION ALL SELECT 'DB', NULL, NULL, 'DATABASE'")
    return warehouse.objects_to_assets(rows)


@query(POLICIES + " SELECT split_part(agent, ':', 1) AS connector, change, count(*) AS n FROM d GROUP BY ALL")
def op_a13_diffs_by_connector(t: Tables) -> DataFrame:
    diffs = policies_diff(t).withColumn("agent", F.replace("agent", F.lit(":"), F.lit("::")))
    return policy.by_connector(diffs, "agent").groupBy("connector", "change").agg(F.count("*").alias("n"))
