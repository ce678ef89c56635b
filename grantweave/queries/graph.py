"""Traversal, tags, access and search over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import build, explore, permissions, tags, traverse
from ..operators import policy
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


def one(t: Tables, node: str) -> DataFrame:
    return t.spark.range(1).select(F.lit(node).alias("source"))


def nodes_like(arcs: DataFrame, prefix: str) -> DataFrame:
    return arcs.select(F.col("dst").alias("node")).union(arcs.select("src")).where(F.startswith("node", F.lit(prefix))).distinct()


@query("WITH RECURSIVE w(node, depth) AS (SELECT dst, 1 FROM {hier_orders} WHERE src = 'region:1' UNION ALL SELECT e.dst, w.depth + 1 FROM w JOIN {hier_orders} e ON e.src = w.node) SELECT node, depth::INTEGER AS depth FROM w")
def op_t01_descendants(t: Tables) -> DataFrame:
    return traverse.reach(t.hier_orders, one(t, "region:1")).select("node", "depth")


@query("WITH RECURSIVE w(node, depth) AS (SELECT dst, 1 FROM {ring} WHERE src = 'n0' UNION SELECT e.dst, w.depth + 1 FROM w JOIN {ring} e ON e.src = w.node WHERE depth < 40) SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node")
def op_t01_descendants_cyclic(t: Tables) -> DataFrame:
    return traverse.reach(t.ring, one(t, "n0")).select("node", "depth")


@query("SELECT DISTINCT src AS source, dst AS node FROM {hier} WHERE src LIKE 'nation:%' AND dst LIKE 'supplier:%'")
def op_t02_children(t: Tables) -> DataFrame:
    return traverse.hop(t.hier, nodes_like(t.hier, "nation:").withColumnRenamed("node", "source"), nodes_like(t.hier, "supplier:"))


PATHS = """WITH RECURSIVE w(source, node, path) AS (SELECT src, dst, [src, dst] FROM {{{arcs}}} WHERE {start}
  UNION ALL SELECT w.source, e.dst, list_append(w.path, e.dst) FROM w JOIN {{{arcs}}} e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst) {extra})"""


@query(PATHS.format(arcs="brands", start="src = 'ECONOMY'", extra="AND w.node <> 'status:O'") + " SELECT source, node, array_to_string(path, ' ⇨ ') AS path FROM w WHERE node = 'status:O'")
def op_t03_paths_between(t: Tables) -> DataFrame:
    pair = one(t, "ECONOMY").withColumn("node", F.lit("status:O"))
    return traverse.paths_between(t.brands, pair).select("source", "node", P.shown(F.col("path")).alias("path"))


@query(PATHS.format(arcs="hier", start="src = 'root'", extra="") + " SELECT node, array_to_string(path, ' ⇨ ') AS path FROM w WHERE node LIKE 'customer:%'")
def op_t04_paths_to_descendants(t: Tables) -> DataFrame:
    return traverse.paths(t.hier, one(t, "root"), target=nodes_like(t.hier, "customer:")).select("node", P.shown(F.col("path")).alias("path"))


@query(PATHS.format(arcs="hier", start="true", extra="") + " SELECT source, node, array_to_string(path, ' ⇨ ') AS path FROM w WHERE source LIKE 'region:%' AND node LIKE 'nation:%'")
def op_t10_hierarchy_downstream(t: Tables) -> DataFrame:
    return traverse.paths(t.hier, nodes_like(t.hier, "region:").withColumnRenamed("node", "source"), target=nodes_like(t.hier, "nation:")).select("source", "node", P.shown(F.col("path")).alias("path"))


def kinds(t: Tables) -> DataFrame:
    return t.hier.select(F.col("dst").alias("node"), F.substring_index("dst", ":", 1).alias("kind"))


COVERED = """WITH RECURSIVE w(source, node, depth) AS (SELECT src, dst, 1 FROM {hier} UNION ALL SELECT w.source, e.dst, w.depth + 1 FROM w JOIN {hier} e ON e.src = w.node),
  p AS (SELECT DISTINCT root, root_depth, path, target_type, agent, privilege, len(string_split(ltrim(path, '/'), '/')) AS least, path LIKE '%**' AS endless FROM {default_rows}),
  covered AS (SELECT p.*, w.node FROM p JOIN w ON w.source = p.root AND (w.depth = p.least OR p.endless AND w.depth >= p.least) AND split_part(w.node, ':', 1) = p.target_type)"""


def covered(t: Tables) -> DataFrame:
    return traverse.default_targets(t.hier, t.default_rows.distinct(), kinds(t))


@query(COVERED + " SELECT root, path, node FROM covered WHERE NOT endless")
def op_t05_default_targets_level(t: Tables) -> DataFrame:
    return covered(t).where(~F.endswith("path", F.lit("**"))).select("root", "path", "node")


@query(COVERED + " SELECT root, path, node FROM covered WHERE endless")
def op_t05_default_targets_open(t: Tables) -> DataFrame:
    return covered(t).where(F.endswith("path", F.lit("**"))).select("root", "path", "node")


TAGGED = """WITH RECURSIVE poison AS (SELECT tag, list(asset) AS bad FROM {removed} GROUP BY tag),
  base AS (SELECT DISTINCT a.tag, a.asset, t.pass_through_hierarchy AS h, t.pass_through_lineage AS l, coalesce(p.bad, []) AS bad FROM {applied} a JOIN {tags} t ON t.tag = a.tag LEFT JOIN poison p ON p.tag = a.tag),
  wh(tag, asset, path, bad) AS (SELECT tag, asset, [asset], bad FROM base WHERE h UNION ALL SELECT w.tag, e.dst, list_append(w.path, e.dst), w.bad FROM wh w JOIN {shallow} e ON e.src = w.asset WHERE NOT list_contains(w.path, e.dst)),
  wl(tag, asset, path, bad) AS (SELECT tag, asset, [asset], bad FROM base WHERE l UNION ALL SELECT w.tag, e.dst, list_append(w.path, e.dst), w.bad FROM wl w JOIN {flow} e ON e.src = w.asset WHERE NOT list_contains(w.path, e.dst)),
  tagged AS (SELECT tag, asset, 'direct' AS via FROM base WHERE NOT list_contains(bad, asset)
    UNION SELECT tag, asset, 'hierarchy' FROM wh WHERE len(path) > 1 AND NOT list_has_any(path, bad)
    UNION SELECT tag, asset, 'lineage' FROM wl WHERE len(path) > 1 AND NOT list_has_any(path, bad))"""


def tag_tables(t: Tables) -> tuple[DataFrame, ...]:
    return t.tags, t.applied, t.removed, t.shallow, t.flow


@query(TAGGED + " SELECT tag, asset, via FROM tagged UNION ALL SELECT DISTINCT tag, asset, 'untagged' FROM {removed}")
def op_t06_assets_for_tag(t: Tables) -> DataFrame:
    return tags.assets_for_tags(*tag_tables(t))


@query(TAGGED + " SELECT asset, tag, via FROM tagged")
def op_t07_tags_for_asset(t: Tables) -> DataFrame:
    return tags.tags_for_assets(*tag_tables(t))


@query(TAGGED + " SELECT DISTINCT asset, tag FROM tagged")
def op_t08_all_tags(t: Tables) -> DataFrame:
    return tags.all_tags(*tag_tables(t))


@query(TAGGED + """, p AS (SELECT tag, asset, path FROM base b, (SELECT [b.asset] AS path) WHERE NOT list_contains(bad, asset)
  UNION SELECT tag, asset, path FROM wh WHERE NOT list_has_any(path, bad) UNION SELECT tag, asset, path FROM wl WHERE NOT list_has_any(path, bad))
  SELECT tag, asset, array_to_string(list_concat(['tag:' || tag], path), ' ⇨ ') AS path FROM p""")
def op_t17_tag_paths(t: Tables) -> DataFrame:
    return tags.tag_paths(*tag_tables(t)).select("tag", "asset", P.shown(F.col("path")).alias("path"))


@query("""WITH s AS (SELECT src AS a, dst AS b FROM {hier} UNION SELECT dst, src FROM {hier}), near AS (SELECT 'region:2' AS node UNION SELECT b FROM s WHERE a = 'region:2')
  SELECT DISTINCT src, dst FROM {hier} WHERE src IN (SELECT node FROM near) OR dst IN (SELECT node FROM near)""")
def op_t09_subgraph(t: Tables) -> DataFrame:
    return traverse.subgraph(t.hier, "region:2", 2)


@query("WITH RECURSIVE w(node) AS (SELECT dst FROM {lineage} WHERE src = 'supplier:1' UNION SELECT e.dst FROM w JOIN {lineage} e ON e.src = w.node) SELECT node FROM w")
def op_t11_lineage_down(t: Tables) -> DataFrame:
    return traverse.reach(t.lineage, one(t, "supplier:1")).select("node")


@query("WITH RECURSIVE w(node) AS (SELECT src FROM {lineage} WHERE dst = 'brand:Brand#1' UNION SELECT e.src FROM w JOIN {lineage} e ON e.dst = w.node) SELECT node FROM w")
def op_t11_lineage_up(t: Tables) -> DataFrame:
    back = t.lineage.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traverse.reach(back, one(t, "brand:Brand#1")).select("node")


@query("SELECT src AS user_id, dst AS group_id FROM {members} WHERE src LIKE 'user:%'")
def op_t12_direct_groups(t: Tables) -> DataFrame:
    return traverse.hop(t.members, nodes_like(t.members, "user:").withColumnRenamed("node", "source")).select(F.col("source").alias("user_id"), F.col("node").alias("group_id"))


@query(PATHS.format(arcs="members", start="src LIKE 'user:%'", extra="") + " SELECT source AS user_id, node AS group_id, array_to_string(path, ' ⇨ ') AS path FROM w WHERE len(path) > 2")
def op_t13_inherited_groups(t: Tables) -> DataFrame:
    found = traverse.paths(t.members, nodes_like(t.members, "user:").withColumnRenamed("node", "source"), min_depth=2)
    return found.select(F.col("source").alias("user_id"), F.col("node").alias("group_id"), P.shown(F.col("path")).alias("path"))


@query("SELECT dst AS group_id, src AS member FROM {members}")
def op_t15_direct_members(t: Tables) -> DataFrame:
    return build.with_inverses(t.members.select(F.lit("m").alias("src_type"), F.col("src").alias("src_id"), F.lit("g").alias("dst_type"), F.col("dst").alias("dst_id"), F.lit("member_of").alias("edge_type"))).where("edge_type = 'includes'").select(F.col("src_id").alias("group_id"), F.col("dst_id").alias("member"))


@query("""WITH RECURSIVE w(source, node, path) AS (SELECT dst, src, [dst, src] FROM {members} WHERE dst = 'regions:1'
  UNION ALL SELECT w.source, e.src, list_append(w.path, e.src) FROM w JOIN {members} e ON e.dst = w.node WHERE NOT list_contains(w.path, e.src)) SELECT node, array_to_string(path, ' ⇨ ') AS path FROM w WHERE node LIKE 'user:%'""")
def op_t16_all_members(t: Tables) -> DataFrame:
    down = t.members.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traverse.paths(down, one(t, "regions:1"), target=nodes_like(t.members, "user:")).select("node", P.shown(F.col("path")).alias("path"))


@query("SELECT DISTINCT user_id, asset_id FROM {perms} WHERE mode = 'allow'")
def op_t18_accessible_assets(t: Tables) -> DataFrame:
    return permissions.access(t.perms).select("user_id", "asset_id")


CHAIN = """WITH RECURSIVE w(node, top, chain) AS (SELECT dst, src, [src] FROM {shallow} UNION ALL SELECT w.node, e.src, list_append(w.chain, e.src) FROM w JOIN {shallow} e ON e.dst = w.top),
  longest AS (SELECT node, arg_max(chain, len(chain)) AS chain FROM w GROUP BY node UNION ALL SELECT 'root', [])"""


def parents(t: Tables) -> DataFrame:
    return t.shallow.select(F.col("dst").alias("child"), F.col("src").alias("parent"))


@query(CHAIN + " SELECT node, array_to_string(chain, '>') AS chain FROM longest")
def op_t22_ancestor_chain(t: Tables) -> DataFrame:
    return traverse.ancestor_chain(parents(t)).select("node", F.array_join("chain", ">").alias("chain"))


@query(CHAIN + " SELECT node, 'warehouse/' || replace(array_to_string(list_concat(list_reverse(chain), [node]), '/'), ':', '_') || '.yaml' AS file FROM longest")
def op_t23_file_path(t: Tables) -> DataFrame:
    from ..sinks.export import file_paths

    return file_paths(traverse.ancestor_chain(parents(t)), "warehouse")


@query("""WITH RECURSIVE below(node) AS (SELECT 'nation:1' UNION SELECT e.dst FROM below b JOIN {flow} e ON e.src = b.node)
  SELECT user_id, string_agg(DISTINCT asset_id, ',' ORDER BY asset_id) AS assets, count(DISTINCT asset_id) AS n_assets FROM {perms} WHERE mode = 'allow' AND asset_id IN (SELECT node FROM below) GROUP BY user_id""")
def op_j08_users_incl_downstream(t: Tables) -> DataFrame:
    found = permissions.users_downstream(t.perms, t.flow, one(t, "nation:1"))
    return found.select("user_id", F.array_join("assets", ",").alias("assets"), F.size("assets").cast("long").alias("n_assets"))


@query(TAGGED + " SELECT DISTINCT g.tag, p.user_id FROM tagged g JOIN {perms} p ON p.asset_id = g.asset AND p.mode = 'allow'")
def op_j07_users_for_tag(t: Tables) -> DataFrame:
    return permissions.users_for_tags(t.perms, tags.all_tags(*tag_tables(t)))


@query(TAGGED + " SELECT p.user_id, g.tag, string_agg(DISTINCT g.asset, ',' ORDER BY g.asset) AS assets FROM tagged g JOIN {perms} p ON p.asset_id = g.asset AND p.mode = 'allow' GROUP BY p.user_id, g.tag")
def op_j06_user_tags(t: Tables) -> DataFrame:
    return permissions.tags_of_users(t.perms, tags.all_tags(*tag_tables(t))).select("user_id", "tag", F.array_join("assets", ",").alias("assets"))


@query("""WITH n AS (SELECT p_name, count(*) AS c, min(p_partkey) AS k FROM {part} GROUP BY p_name),
  refs AS (SELECT concat('r', p_partkey) AS ref, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS typ FROM {part}),
  e AS (SELECT p_name, p_type, min(p_partkey) AS k FROM {part} GROUP BY p_name, p_type)
  SELECT r.ref, coalesce(e.k, CASE WHEN r.typ IS NULL AND n.c = 1 THEN n.k END) AS asset FROM refs r LEFT JOIN e ON e.p_name = r.p_name AND e.p_type = r.typ LEFT JOIN n ON n.p_name = r.p_name""")
def op_j04_edge_resolution(t: Tables) -> DataFrame:
    refs = t.sql("SELECT concat('r', p_partkey) AS ref, 'w' AS connector, array(p_name) AS path, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS asset_type FROM {part}")
    typed = t.part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("asset"), F.count("*").alias("n"))
    # parts that share name and type stand for one asset each, so a name is unique only if one part has it
    every = t.part.groupBy("p_name").agg(F.count("*").alias("parts"))
    assets = typed.join(every, "p_name").select(F.lit("w").alias("connector"), F.array("p_name").alias("path"), F.col("p_type").alias("asset_type"), "asset", "parts")
    twins = assets.where("parts > 1").select("connector", "path", F.lit("").alias("asset_type"), F.lit(-1).cast("long").alias("asset"))
    return build.resolve_edges(refs, assets.drop("parts").unionByName(twins)).select("ref", "asset")


@query("""WITH a AS (SELECT DISTINCT concat(p_brand, '::', p_type) AS asset FROM {part}),
  tg AS (SELECT DISTINCT concat('::', p_type) AS pattern FROM {part} UNION SELECT DISTINCT concat(lower(p_brand), '::economy') FROM {part} UNION SELECT 'nothing'),
  s AS (SELECT tg.pattern, a.asset, CASE WHEN ends_with(a.asset, tg.pattern) THEN 1 WHEN ends_with(lower(a.asset), lower(tg.pattern)) THEN 2 WHEN contains(lower(a.asset), lower(tg.pattern)) THEN 3 END AS stage FROM tg, a),
  k AS (SELECT pattern, count(*) FILTER (stage = 1) AS n1, count(*) FILTER (stage = 2) AS n2, count(*) FILTER (stage = 3) AS n3, min(asset) FILTER (stage = 1) AS a1, min(asset) FILTER (stage = 2) AS a2, min(asset) FILTER (stage = 3) AS a3 FROM s GROUP BY pattern),
  r AS (SELECT *, CASE WHEN n1 > 0 THEN n1 ELSE n2 END AS suf, n1 + n2 + n3 AS every FROM k),
  f AS (SELECT pattern, CASE WHEN suf = 1 THEN CASE WHEN n1 > 0 THEN a1 ELSE a2 END WHEN every = 1 THEN coalesce(a1, a2, a3) END AS asset, every FROM r)
  SELECT pattern, asset, CASE WHEN asset IS NOT NULL THEN 'matched' WHEN every > 1 THEN 'too many' ELSE 'no match' END AS outcome FROM f""")
def op_j21_tag_match(t: Tables) -> DataFrame:
    targets = t.sql("SELECT DISTINCT concat('::', p_type) AS pattern FROM {part} UNION SELECT DISTINCT concat(lower(p_brand), '::economy') FROM {part} UNION SELECT 'nothing'").withColumn("kind", F.lit(None).cast("string"))
    assets = t.sql("SELECT DISTINCT concat(p_brand, '::', p_type) AS asset, 'table' AS kind FROM {part}")
    return tags.match_targets(targets, assets).select("pattern", "asset", "outcome")


def node_table(t: Tables) -> DataFrame:
    return t.sql("""SELECT 'user' AS node_type, concat('user:', c_custkey) AS node_id, c_name AS name, array('crm') AS connectors, CAST(NULL AS STRING) AS asset_type FROM {customer}
      UNION ALL SELECT 'group', concat('nations:', n_nationkey), n_name, array('crm'), NULL FROM {nation}
      UNION ALL SELECT 'asset', concat('supplier:', s_suppkey), s_name, array('dw'), 'supplier' FROM {supplier}
      UNION ALL SELECT 'policy', concat('policy:', r_regionkey), r_name, array('dw'), NULL FROM {region}
      UNION ALL SELECT 'default_policy', concat('default:', r_regionkey), r_name, array('dw'), NULL FROM {region}""")


NODES = """WITH nodes AS (SELECT 'user' AS node_type, concat('user:', c_custkey) AS node_id, c_name AS name, 'crm' AS connector, NULL AS asset_type FROM {customer}
  UNION ALL SELECT 'group', concat('nations:', n_nationkey), n_name, 'crm', NULL FROM {nation} UNION ALL SELECT 'asset', concat('supplier:', s_suppkey), s_name, 'dw', 'supplier' FROM {supplier}
  UNION ALL SELECT 'policy', concat('policy:', r_regionkey), r_name, 'dw', NULL FROM {region} UNION ALL SELECT 'default_policy', concat('default:', r_regionkey), r_name, 'dw', NULL FROM {region})"""


@query(NODES + " SELECT node_type, CASE WHEN node_type <> 'default_policy' THEN node_id END AS node_id, name, connector, asset_type FROM nodes WHERE node_type <> 'policy'")
def op_p02_nodes(t: Tables) -> DataFrame:
    return explore.summaries(explore.listed(node_table(t))).withColumn("connector", F.array_join("connectors", ",")).drop("connectors")


@query(NODES + " SELECT node_type, node_id, name FROM nodes WHERE node_type IN ('user', 'asset')")
def op_p03_lists(t: Tables) -> DataFrame:
    return explore.listed(node_table(t), "user", "asset").select("node_type", "node_id", "name")


@query(NODES + " SELECT node_type, node_id, name FROM nodes WHERE node_id = 'supplier:7'")
def op_p04_lookup(t: Tables) -> DataFrame:
    return explore.by_id(node_table(t), "supplier:7", "asset").select("node_type", "node_id", "name")


@query("SELECT user_id, asset_id, privilege, seq FROM {perms} WHERE mode = 'allow'")
def op_p05_allow_only(t: Tables) -> DataFrame:
    return permissions.allowed(t.perms).select("user_id", "asset_id", "privilege", "seq")


@query(NODES + ", ranked AS (SELECT *, CASE node_type WHEN 'user' THEN 1 WHEN 'group' THEN 2 WHEN 'asset' THEN 3 WHEN 'policy' THEN 4 ELSE 6 END AS r FROM nodes) SELECT node_type, name, row_number() OVER (ORDER BY r, name, node_id) AS place FROM ranked")
def op_r01_sorted_nodes(t: Tables) -> DataFrame:
    return explore.placed(node_table(t)).select("node_type", "name", "place")


@query("SELECT doc_id FROM {documents} WHERE contains(lower(text), 'the') AND contains(lower(text), 'heed')")
def op_r04_search(t: Tables) -> DataFrame:
    return explore.search(t.documents, "text", "The heed").select("doc_id")


@query("SELECT doc_id FROM {documents} WHERE contains(lower(text), 'the') AND contains(lower(text), 'heed') ORDER BY doc_id LIMIT 10")
def op_r04_search_limit(t: Tables) -> DataFrame:
    return explore.search(t.documents, "text", "the heed", limit=10, order="doc_id").select("doc_id")


@query(NODES + " SELECT node_id, name FROM nodes WHERE node_type = 'user' ORDER BY name LIMIT 20 OFFSET 20")
def op_r05_page(t: Tables) -> DataFrame:
    return explore.page(explore.listed(node_table(t), "user"), 1, 20).select("node_id", "name")


@query(NODES + " SELECT node_type, count(*) AS count FROM nodes GROUP BY node_type")
def op_a16_counts(t: Tables) -> DataFrame:
    return explore.counts(node_table(t))


@query("SELECT src_type, src_id, dst_type, dst_id, edge_type FROM (SELECT 'user' AS src_type, c_name AS src_id, 'group' AS dst_type, c_mktsegment AS dst_id, 'member_of' AS edge_type FROM {customer} UNION SELECT 'group', c_mktsegment, 'user', c_name, 'includes' FROM {customer} UNION SELECT 'user', c_name, 'policy', concat('p', c_nationkey), 'granted_from' FROM {customer} UNION SELECT 'policy', concat('p', c_nationkey), 'user', c_name, 'granted_to' FROM {customer}) x")
def op_m02_edges(t: Tables) -> DataFrame:
    users = t.customer.select("c_name", F.array("c_mktsegment").alias("groups"), F.array(F.concat(F.lit("p"), "c_nationkey")).alias("policies"))
    return build.edges_of(users, "user", "c_name", {"groups": ("member_of", "group"), "policies": ("granted_from", "policy")})


@query("SELECT dst AS src_id, src AS dst_id, 'parent_of' AS edge_type FROM {hier} UNION SELECT src, dst, 'child_of' FROM {hier}")
def op_x06_inverse_edges(t: Tables) -> DataFrame:
    typed = t.hier.select(F.lit("asset").alias("src_type"), F.col("src").alias("src_id"), F.lit("asset").alias("dst_type"), F.col("dst").alias("dst_id"), F.lit("child_of").alias("edge_type"))
    return build.with_inverses(typed).select("src_id", "dst_id", "edge_type")


@query("SELECT src, dst FROM {hier} UNION SELECT src, dst FROM {shallow} UNION SELECT src, dst FROM {flow}")
def op_x03_edge_union(t: Tables) -> DataFrame:
    return build.union_edges(t.hier, t.shallow, t.flow)


@query("""WITH RECURSIVE a AS (SELECT concat('customer:', o_custkey) AS src, concat('order:', o_orderkey) AS dst FROM {orders} UNION SELECT concat('order:', l_orderkey), concat('part:', l_partkey) FROM {lineitem})
  SELECT DISTINCT x.src, y.dst FROM a x JOIN a y ON y.src = x.dst""")
def op_s06_contraction(t: Tables) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    arcs = t.orders.select(key("customer", "o_custkey").alias("src"), key("order", "o_orderkey").alias("dst"))
    arcs = arcs.union(t.lineitem.select(key("order", "l_orderkey"), key("part", "l_partkey")))  # equal ones meet in the contraction's own distinct
    return traverse.contract(arcs, t.orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("node")))


@query("""WITH RECURSIVE c AS (SELECT concat('user:', l_suppkey) AS user_name FROM {lineitem} WHERE l_shipdate < '1999-01-01'), e AS (SELECT concat('user:', o_custkey) AS user_name FROM {orders})
  SELECT user_name, 'left' AS side FROM (SELECT user_name FROM c EXCEPT SELECT user_name FROM e) UNION ALL SELECT user_name, 'right' FROM (SELECT user_name FROM e EXCEPT SELECT user_name FROM c)""")
def op_j23_two_sided(t: Tables) -> DataFrame:
    user = lambda df, c: df.select(F.concat(F.lit("user:"), c).alias("user_name"))
    return policy.two_sided(user(t.lineitem.where("l_shipdate < '1999-01-01'"), "l_suppkey"), user(t.orders, "o_custkey"), "user_name")


@query(PATHS.format(arcs="back", start="true", extra="").replace("WITH RECURSIVE", "WITH RECURSIVE back AS (SELECT dst AS src, src AS dst FROM {hier}),").replace("{back}", "back") + " SELECT source, node, array_to_string(path, ' ⇨ ') AS path FROM w WHERE source LIKE 'supplier:%'")
def op_t10_hierarchy_upstream(t: Tables) -> DataFrame:
    back = t.hier.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = traverse.paths(back, nodes_like(t.hier, "supplier:").withColumnRenamed("node", "source"))
    return found.select("source", "node", P.shown(F.col("path")).alias("path"))


@query(PATHS.format(arcs="flow", start="true", extra="") + " SELECT source, node, array_to_string(path, ' ⇨ ') AS path FROM w")
def op_t11_lineage_paths(t: Tables) -> DataFrame:
    found = traverse.paths(t.flow, t.flow.select(F.col("src").alias("source")).distinct())
    return found.select("source", "node", P.shown(F.col("path")).alias("path"))


@query("SELECT src AS group_id, dst AS parent FROM {members} WHERE src NOT LIKE 'user:%'")
def op_t14_groups_of_groups(t: Tables) -> DataFrame:
    kept = t.members.where("src NOT LIKE 'user:%'")
    return traverse.hop(kept, kept.select(F.col("src").alias("source")).distinct()).select(F.col("source").alias("group_id"), F.col("node").alias("parent"))


@query(TAGGED + " SELECT asset, tag, via FROM tagged WHERE asset = 'nation:3'")
def op_t07_tags_of_one_asset(t: Tables) -> DataFrame:
    near = tags.towards(one(t, "nation:3").withColumnRenamed("source", "asset"), *tag_tables(t))
    return tags.tags_for_assets(*near).where("asset = 'nation:3'")


@query(TAGGED + " SELECT asset, via FROM tagged WHERE tag = 'tag3'")
def op_t06_assets_of_one_tag(t: Tables) -> DataFrame:
    return tags.assets_for_tags(*tags.of_tag("tag3", *tag_tables(t))).where("via != 'untagged'").select("asset", "via")
