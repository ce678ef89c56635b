"""Metadata in differences, validation rules, whole graphs, restarted streams and numbered rows."""

import pytest
from pyspark.sql import functions as F

from grantweave.operators import assemble, explore, policy, tags, traverse, validate, warehouse
from grantweave.storage import numbered, stored
from grantweave.streaming.watch import Watcher

STATE = "asset string, agent_type string, agent string, privileges array<string>, metadata map<string,string>"


def test_metadata_alone_is_a_change(spark):
    want = spark.createDataFrame([("a", "user", "u", ["R"], {"k": "1"}), ("b", "user", "u", ["R"], {"k": "1"}), ("c", "user", "u", [], {}), ("d", "user", "u", [], {"k": "2"})], STATE)
    have = spark.createDataFrame([("a", "user", "u", ["R"], {"k": "0", "x": "y"}), ("b", "user", "u", ["R"], {"k": "1"})], STATE)
    found = {r.asset: (r.change, r.to_add, r.to_remove, r.add_metadata, r.remove_metadata) for r in policy.policy_diff(want, have).collect()}
    assert found == {"a": ("modify", [], [], {"k": "1"}, {"k": "0", "x": "y"}), "d": ("add", [], [], {"k": "2"}, {})}
    folded = policy.fold(want.where("asset < 'c'").withColumn("asset", F.lit("z")), ["asset"]).collect()
    assert [(r.metadata, r.users) for r in folded] == [({"k": "1"}, ["u"])]


def test_group_rules(spark):
    groups = spark.createDataFrame([("c1::a", {"c1": "x"}, ["c2::b", "no"]), ("c2::b", {"c1": "x", "c9": "y"}, []), ("c8::z", {}, ["c1::a"])], "name string, identifiers map<string,string>, member_of array<string>")
    found = {(r.rule, r.subject) for r in validate.groups(groups, spark.createDataFrame([("c1",), ("c2",)], "connector string")).collect()}
    assert found == {("group across connectors", "c1::a"), ("group across connectors", "c8::z"), ("unknown parent group", "c1::a"), ("group mapped twice", "x"), ("group connector", "c2::b"), ("group prefix", "c8::z")}


def test_identity_changes_move_memberships(spark):
    nodes = spark.createDataFrame([("u1", ["c1", "c2"]), ("u2", ["c1"])], "node_id string, connectors array<string>")
    edges = spark.createDataFrame([("u1", "g", "c1", "member_of"), ("u1", "h", "c2", "member_of"), ("u2", "g", "c1", "member_of")], "user string, other string, connector string, edge_type string")
    known = spark.createDataFrame([("c1", "l1", "u1"), ("c2", "l2", "u1"), ("c1", "l3", "u2")], "connector string, local_name string, user_name string")
    renames = spark.createDataFrame([("c1", "l1", "u1", "new"), ("c1", "l3", "u2", "new")], "connector string, local_name string, old string, new string")
    users, moved, ids = assemble.change_identities(nodes, edges, known, renames)
    assert {(r.node_id, tuple(r.connectors)) for r in users.collect()} == {("u1", ("c2",)), ("new", ("c1",))}
    assert {tuple(r)[:2] for r in moved.collect()} == {("new", "g"), ("u1", "h")}
    assert {tuple(r) for r in ids.collect()} == {("c1", "l1", "new"), ("c2", "l2", "u1"), ("c1", "l3", "new")}


def test_renamed_users_are_not_reported_twice(spark):
    ids = lambda name: spark.createDataFrame([(name, "c", "l"), ("v", "c", "m")], "user_name string, connector string, local_name string")
    members = lambda name: spark.createDataFrame([(name, ["g"]), ("v", ["g"])], "user_name string, groups array<string>")
    held = lambda name, p: spark.createDataFrame([("a", "user", name, ["R"], {}), ("a", "group", "g", p, {})], STATE)
    none = spark.createDataFrame([], "name string, member_of array<string>"), spark.createDataFrame([], "root string, path string, target_type string, agent_type string, agent string, privileges array<string>, connector_managed boolean")
    side = lambda name, p: {"identities": ids(name), "memberships": members(name), "groups": none[0], "policies": held(name, p), "default_policies": none[1]}
    d = assemble.all_diffs(side("new", ["R"]), side("old", ["R", "W"]))
    assert {(r.user_name, r.change) for r in d["users"].collect()} == {("new", "add"), ("old", "remove")}
    assert [(r.agent, r.to_remove) for r in d["policies"].collect()] == [("g", ["W"])]
    assert d["groups"].count() == d["default_policies"].count() == 0


def test_a_restarted_stream_keeps_its_state(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n long, deleted boolean")
    one = lambda: Watcher(spark, "k", "n", str(tmp_path / "state"))

    def take(*x):
        rows(*x).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        w = one()  # a new object, as after a restart
        w.start(spark.readStream.schema("k string, n long, deleted boolean").parquet(str(tmp_path / "in"))).awaitTermination()
        return {(r.k, r.n) for r in w.state().collect()}

    assert take(("a", 1, False), ("b", 1, False)) == {("a", 1), ("b", 1)}
    assert take(("c", 1, False)) == {("a", 1), ("b", 1), ("c", 1)}
    assert take(("a", 2, True), ("b", 2, False)) == {("b", 2), ("c", 1)}
    assert one().versions() == [1, 2]
    again = one()
    again.apply(rows(("a", 2, True), ("b", 2, False)), 2)  # a batch that is tried again
    assert {(r.k, r.n) for r in again.state().collect()} == {("b", 2), ("c", 1)}


def test_numbered_rows(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50) for i in range(50)], "part int, v int").repartition(4)
    found = {(r.part, r.v): r.n for r in numbered(df, [F.col("v")], "n", "part").collect()}
    for part in range(3):
        mine = sorted(v for p, v in found if p == part)
        assert [found[part, v] for v in mine] == list(range(1, len(mine) + 1))
    assert numbered(df.limit(0), [F.col("v")], "n").count() == 0


def test_targets_by_joined_endings(spark):
    assets = spark.createDataFrame([(a, k) for a, k in [("x::one", "t"), ("y::ONE", "t"), ("z::two", "v"), ("w::two", "t"), ("mid::three::end", "t")]], "asset string, kind string")
    targets = spark.createDataFrame([("one", None), ("One", None), ("two", "t"), ("two", None), ("three", None), ("two", "none"), ("zero", None), ("::end", "t")], "pattern string, kind string")
    found = {(r.pattern, r.kind): (r.asset, r.outcome) for r in tags.match_targets(targets, assets).collect()}
    assert found == {
        ("one", None): ("x::one", "matched"), ("One", None): (None, "too many"), ("two", "t"): ("w::two", "matched"), ("two", None): (None, "too many"), ("three", None): ("mid::three::end", "matched"),
        ("two", "none"): (None, "bad type"), ("zero", None): (None, "no match"), ("::end", "t"): ("mid::three::end", "matched"),
    }


def test_open_ended_includes(spark):
    names = spark.createDataFrame([(n,) for n in ("DB", "DB.A", "DB.AB.x", "DB.B.y", "DC")], "name string")
    patterns = spark.createDataFrame([("DB.A*",), ("DC",)], "pattern string")
    assert {r.name for r in warehouse.include(names, patterns).collect()} == {"DB", "DB.A", "DB.AB.x", "DC"}


def test_tags_of_one_asset_look_upwards_only(spark):
    pair = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    at = lambda *x: spark.createDataFrame(list(x), "tag string, asset string")
    flags = spark.createDataFrame([("t", True, False), ("u", True, True)], "tag string, pass_through_hierarchy boolean, pass_through_lineage boolean")
    tables = flags, at(("t", "top"), ("u", "other"), ("u", "leaf")), at(("t", "mid")), pair(("top", "mid"), ("mid", "leaf"), ("top", "leaf"), ("other", "away")), pair(("other", "mid"))
    one = spark.createDataFrame([("leaf",)], "asset string")
    near = [tuple(r) for r in tags.tags_for_assets(*tags.towards(one, *tables)).where("asset = 'leaf'").collect()]
    assert sorted(near) == sorted(tuple(r) for r in tags.tags_for_assets(*tables).where("asset = 'leaf'").collect()) and len(near) == 2


def test_many_hops_and_too_many_paths(spark):
    chain = stored(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "n3")], "src string, dst string"))
    start = spark.createDataFrame([("n0",)], "source string")
    assert {r.node: r.depth for r in traverse.reach(chain, start).collect()} == {f"n{i}": i for i in range(1, 13)}
    dense = spark.createDataFrame([(f"a{i}", f"a{j}") for i in range(6) for j in range(6) if i != j], "src string, dst string")
    with pytest.raises(ValueError, match="paths"):
        traverse.paths(dense, spark.createDataFrame([("a0",)], "source string"), most=50)
    assert explore.placed(spark.createDataFrame([], "node_type string, name string, node_id string")).count() == 0
