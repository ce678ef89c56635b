from grantweave.operators import build, permissions, warehouse


def test_edges_of_a_group(spark):
    row = spark.createDataFrame([("Group 1", ["a", "b"], ["User a"], ["c"], ["Policy 1"])], "name string, member_of array<string>, users array<string>, groups array<string>, granted array<string>")
    edges = build.edges_of(row, "group", "name", {"member_of": ("member_of", "group"), "users": ("includes", "user"), "groups": ("includes", "group"), "granted": ("granted_from", "policy")})
    found = {tuple(r) for r in edges.collect()}
    assert len(found) == 10
    assert ("policy", "Policy 1", "group", "Group 1", "granted_to") in found


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, connectors array<string>, metadata map<string,string>, kind string")


def test_merge_unites_sets_and_maps(spark):
    merged, conflicts = build.merge_nodes(nodes(spark, ("g", ["test1"], {"a": "1"}, "x"), ("g", ["test2"], {"b": "2"}, "x")), ["name"], ["connectors"], ["metadata"], ["kind"])
    row = merged.first()
    assert row.connectors == ["test1", "test2"] and row.metadata == {"a": "1", "b": "2"} and not conflicts.count()


def test_merge_reports_conflicts(spark):
    _, conflicts = build.merge_nodes(nodes(spark, ("g", ["t"], {"a": "1"}, "x"), ("g", ["t"], {"a": "2"}, "y")), ["name"], ["connectors"], ["metadata"], ["kind"])
    assert {(r.column, r.detail) for r in conflicts.collect()} == {("metadata", "a"), ("kind", None)}


def test_typeless_reference_needs_a_unique_path(spark):
    assets = spark.createDataFrame([("w", ["a"], "table", "A"), ("w", ["b"], "table", "B1"), ("w", ["b"], "view", "B2")], "connector string, path array<string>, asset_type string, asset string")
    refs = spark.createDataFrame([("1", "w", ["a"], None), ("2", "w", ["b"], None), ("3", "w", ["b"], "view"), ("4", "w", ["a"], "view")], "ref string, connector string, path array<string>, asset_type string")
    assert {r.ref: r.asset for r in build.resolve_edges(refs, assets).collect()} == {"1": "A", "2": None, "3": "B2", "4": None}


def merged(spark, *rows):
    df = spark.createDataFrame([("u", "a", p, m, None, [r], i) for i, (p, m, r) in enumerate(rows)], "user_id string, asset_id string, privilege string, mode string, mode_detail string, reasons array<string>, seq long")
    return {r.privilege: (r.mode, r.reasons) for r in permissions.merge(df).collect()}


def test_permission_merge(spark):
    assert merged(spark, ("p", "allow", "x"), ("p", "deny", "y")) == {"p": ("deny", ["y"])}
    assert merged(spark, ("p", "allow", "x"), ("p", "allow", "y")) == {"p": ("allow", ["x", "y"])}
    assert merged(spark, ("p", "allow", "x"), ("p", "deny", "y"), ("p", "allow", "z"), ("p", "allow", "w")) == {"p": ("allow", ["z", "w"])}
    assert len(merged(spark, ("p", "allow", "x"), ("q", "allow", "y"))) == 2


def test_user_without_permissions_sees_nothing(spark):
    empty = spark.createDataFrame([], "user_id string, asset_id string, privilege string, mode string, seq long")
    assert permissions.access(empty).count() == 0


def test_include_list(spark):
    patterns = spark.createDataFrame([(p,) for p in ("A.B*", "D", "E*", "H.I", "F.G.J", "X.*")], "pattern string")
    assert {r.pattern for r in warehouse.expand_includes(patterns).collect()} == {"A.B*", "A", "D", "E*", "F", "F.G", "F.G.J", "H", "H.I", "X.*", "X"}
    names = ("A.B.C", "A.BC", "F", "F.G", "F.G.J", "X", "X.X", "D.A", "F.G.A", "Z.G.A")
    found = warehouse.include(spark.createDataFrame([(n,) for n in names], "name string"), patterns)
    assert {r.name for r in found.collect()} == set(names[:7])


def test_grants(spark):
    grants = spark.createDataFrame([("grantee", "DATABASE", "db", "priv"), ("grantee", "DATABASE", "db", "priv2"), ("grantee", "STAGE", "s", "x")], "role string, kind string, asset string, privilege string")
    assert [tuple(r) for r in warehouse.grants_to_policies(grants).collect()] == [("snowflake.grantee.db", "grantee", "db", ["priv", "priv2"])]
    future = spark.createDataFrame([("r", "DB.<SCHEMA>", "SCHEMA", "USAGE"), ("r", "DB.<TABLE>", "TABLE", "SELECT"), ("r", "DB.S.<TABLE>", "TABLE", "SELECT")], "role string, name string, target string, privilege string")
    assert {(r.root, r.path, r.target_type) for r in warehouse.future_grants_to_defaults(future).collect()} == {("DB", "/*", "SCHEMA"), ("DB", "/*/*", "TABLE"), ("DB.S", "/*", "TABLE")}


def test_duplicate_edges_are_one(spark):
    e = spark.createDataFrame([("a", "1", "b", "2", "child_of"), ("a", "1", "b", "2", "child_of")], "src_type string, src_id string, dst_type string, dst_id string, edge_type string")
    assert {tuple(r) for r in build.with_inverses(e).collect()} == {("a", "1", "b", "2", "child_of"), ("b", "2", "a", "1", "parent_of")}
