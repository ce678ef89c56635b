from pyspark.sql import functions as F

from grantweave import capabilities, schemas
from grantweave.graph import AccessGraph
from grantweave.operators import build, state

ARCS = [
    ("user", "u", "group", "g1", "member_of"), ("user", "u", "group", "g2", "member_of"), ("group", "g2", "group", "g3", "member_of"),
    ("group", "g1", "policy", "p", "granted_from"), ("policy", "p", "asset", "a", "governs"), ("default_policy", "d", "asset", "a", "provided_default_for_children"),
    ("default_policy", "d", "group", "g3", "granted_to"), ("asset", "b", "asset", "a", "child_of"), ("asset", "c", "asset", "b", "derived_from"), ("asset", "a", "tag", "t", "tagged_as"),
]


def graph(spark):
    edges = build.with_inverses(spark.createDataFrame(ARCS, schemas.EDGES))
    rows = [(t, i) for t, i in {(a, b) for s, x, d, y, _ in ARCS for a, b in ((s, x), (d, y))}]
    nodes = spark.createDataFrame(rows, "node_type string, node_id string").select(
        "*", F.col("node_id").alias("name"), F.array(F.lit("c")).alias("connectors"), F.lit(None).cast("string").alias("asset_type"), F.lit(True).alias("pass_through_hierarchy"), F.lit(False).alias("pass_through_lineage"),
        F.array(F.lit("P")).alias("privileges"), F.lit("/*").alias("matching_path"), F.lit("table").alias("target_type"),
    )
    allowed = spark.createDataFrame([("u", "c", "read", "allow", None, [], 1), ("v", "b", "read", "deny", None, [], 2)], schemas.PERMISSIONS)
    return AccessGraph(nodes, edges, allowed)


def values(df, column="node"):
    return sorted(r[column] for r in df.collect())


def test_questions(spark, tmp_path):
    g = graph(spark)
    assert values(g.direct_groups("u")) == ["g1", "g2"] and values(g.direct_members("g3", "group")) == ["g2"]
    assert [r.path for r in g.inherited_groups("u").collect()] == [["user:u", "group:g2", "group:g3"]]
    assert values(g.all_members("g3")) == ["user:u"]
    assert values(g.hierarchy("b")) == ["a"] and values(g.lineage("b", up=False)) == ["c"]
    assert values(g.users_of_asset("b"), "user_id") == [] and values(g.users_of_asset("b", downstream=True), "user_id") == ["u"]
    assert values(g.assets_of_user("u"), "asset_id") == ["c"]
    assert {tuple(r) for r in g.assets_of_tag("t").collect()} == {("a", "direct"), ("b", "hierarchy")}
    assert {tuple(r) for r in g.tags_of_asset("b").collect()} == {("t", "hierarchy")} and g.users_of_tag("t").count() == 0 and g.tags_of_user("u").count() == 0
    assert {len(r.path) for r in g.tag_paths("t").collect()} == {2, 3}
    assert g.subgraph("tag", "t", 1).count() == 2 and g.drawing("tag", "t", 1).count() == 4
    assert g.list("user").count() == 1 and g.node("u", "user").count() == 1
    g.save(str(tmp_path / "s"), spark.createDataFrame([], schemas.IDENTITIES))
    assert AccessGraph.load(spark, str(tmp_path / "s")).edges.count() == g.edges.count()


def test_observed_state(spark):
    g = graph(spark)
    assert [tuple(r) for r in state.observed_policies(g.nodes, g.edges).collect()] == [("a", "group", "g1", ["P"])]
    found, wrong = state.observed_default_policies(g.nodes, g.edges)
    assert [tuple(r) for r in found.collect()] == [("a", "/*", "table", "group", "g3", ["P"], True)] and not wrong.count()
    assert {r.name: r.groups for r in state.observed_memberships(spark.createDataFrame([("u",), ("x",)], "name string"), g.edges).collect()} == {"u": ["g1", "g2"], "x": []}


def test_nested_groups_are_spread_where_they_cannot_nest(spark):
    groups = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "group string, parent string")
    assert {(r.group, r.ancestor) for r in state.expand_nested(groups).collect()} == {(x, y) for x in "abc" for y in "abc"} | {("d", "d")}
    names = spark.createDataFrame([(g, c, f"{c}_{g}") for g in "abcd" for c in ("snowflake", "tableau")], "group string, connector string, local string")
    writers = capabilities.group_writers(spark)
    want = {(r.connector, r.name): r.member_of for r in state.desired_groups(groups, names, writers).collect()}
    assert want["snowflake", "snowflake_a"] == ["snowflake_b"] and want["tableau", "tableau_a"] == [] and want["snowflake", "snowflake_d"] == []
    users = spark.createDataFrame([("u", "a")], "user_name string, group string")
    got = {r.connector: r.groups for r in state.desired_memberships(users, groups, names, writers).collect()}
    assert got == {"snowflake": ["snowflake_a"], "tableau": ["tableau_a", "tableau_b", "tableau_c"]}


def test_checks(spark):
    table = capabilities.catalogue(spark)
    rows = spark.createDataFrame([("x", "snowflake", "TABLE", ["SELECT", "FLY"]), ("y", "tableau", "flow", ["AllowRead", "Read"])], "asset string, connector string, asset_type string, privileges array<string>")
    assert {tuple(r) for r in state.illegal_privileges(rows, table).collect()} == {("x", "FLY"), ("y", "Read")}
    configured = spark.createDataFrame([("c", "n", None), ("c", "m", "t")], "connector string, name string, type string")
    assets = spark.createDataFrame([("c", "n", None, "A"), ("c", "m", "t", "B"), ("c", "m", "t", "C")], "connector string, name string, type string, asset string")
    good, bad = state.identify_assets(configured, assets)
    assert values(good, "asset") == ["A"] and values(bad, "name") == ["m"]
    defaults = spark.createDataFrame([("p", "project", "Locked"), ("p", "project", "Managed"), ("q", "project", "Locked")], "root string, target_type string, content_permissions string")
    assert values(state.content_permission_conflicts(defaults), "root") == ["p"]
    tagged = state.overlay_tags(graph(spark).edges, spark.createDataFrame([("t2", "b")], "tag string, asset string"), spark.createDataFrame([("t", "b")], "tag string, asset string"))
    assert tagged.where("dst_id = 't2' OR src_id = 't2'").count() == 2


def test_identities(spark):
    rows = spark.createDataFrame([("u", "b", "x"), ("u", "a", "y"), ("u", "b", "x"), ("v", "a", "z")], "user_name string, connector string, local string")
    assert {r.user_name: r.ids for r in state.identities(rows).collect()} == {"u": ["a=y", "b=x"], "v": ["a=z"]}
