import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantweave.operators import policy
from grantweave.plans import bi_rest, warehouse_sql

STATE = "asset string, agent_type string, agent string, privileges array<string>"


def state(spark, *rows):
    return spark.createDataFrame([(a, "group", g, p) for a, g, p in rows], STATE)


def defaults(spark, *rows):
    return spark.createDataFrame([(a, "group", g, d, path, p) for a, g, d, path, p in rows], "asset string, agent_type string, agent string, root_depth int, path string, privileges array<string>")


def content(df):
    return {(r.asset, r.agent): sorted(r.privileges) for r in df.collect()}


def test_priority_and_explicit_policies(spark):
    d = defaults(spark, ("s", "g", 2, "/*", ["A"]), ("s", "g", 2, "/**", ["B"]), ("s", "g", 1, "/*/*", ["C"]), ("t", "g", 1, "/*", ["D"]), ("t", "g", 1, "/*", ["E"]))
    assert content(policy.expand(state(spark), d)) == {("s", "g"): ["A"], ("t", "g"): ["D", "E"]}
    assert content(policy.expand(state(spark, ("s", "g", [])), d))["s", "g"] == []


def test_compaction_and_expansion_are_inverse(spark):
    d = defaults(spark, ("s", "g", 2, "/*", ["A"]), ("s", "g", 1, "/**", ["B"]), ("t", "g", 1, "/*", ["D"]), ("u", "g", 1, "/*", ["E"]))
    wanted = state(spark, ("s", "g", ["B"]), ("t", "g", ["D"]), ("v", "g", ["X"]))
    small = policy.compact(wanted, d)
    assert content(small) == {("s", "g"): ["B"], ("u", "g"): [], ("v", "g"): ["X"]}
    back = content(policy.expand(small, d))
    assert {k: v for k, v in back.items() if v} == content(wanted)


def test_policy_diff(spark):
    wanted = state(spark, ("a", "g", ["X", "Y"]), ("b", "g", ["X"]), ("c", "g", []), ("e", "g", ["Z"]))
    have = state(spark, ("a", "g", ["Y", "Z"]), ("c", "g", ["X"]), ("d", "g", ["W"]), ("e", "g", ["Z"]))
    found = {r.asset: (r.change, r.to_add, r.to_remove) for r in policy.policy_diff(wanted, have).collect()}
    assert found == {"a": ("modify", ["X"], ["Z"]), "b": ("add", ["X"], []), "c": ("remove", [], ["X"]), "d": ("remove", [], ["W"])}


WITH_METADATA = STATE + ", metadata map<string,string>, seq int"


def test_metadata_merges_key_by_key(spark):
    rows = spark.createDataFrame([("a", "user", "u", ["X"], {"k": "1"}, 1), ("a", "user", "u", ["Y"], {"k": "2", "y": "3"}, 2), ("b", "user", "u", ["Z"], None, 3)], WITH_METADATA)
    found = {r.asset: (r.privileges, r.metadata) for r in policy.combine(rows).collect()}
    assert found == {"a": (["X", "Y"], {"k": "1", "y": "3"}), "b": (["Z"], {})}
    assert [tuple(r)[3:] for r in policy.metadata_conflicts(rows).collect()] == [("k", "1", ["2"])]


def test_metadata_of_the_last_row_in_each_file(spark):
    rows = [("f", "a", "user", "u", ["X"], {"x": "1"}, 1), ("f", "a", "user", "u", ["Y"], {"y": "2"}, 2), ("g", "a", "user", "u", ["Z"], {"y": "3", "z": "4"}, 3)]
    r = policy.last_in_file(spark.createDataFrame(rows, "file string, " + WITH_METADATA)).first()
    assert r.privileges == ["Y", "Z"] and r.metadata == {"y": "2", "z": "4"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("stuvw"), st.tuples(st.sampled_from([["A"], ["B"], ["A", "B"]]), st.dictionaries(st.sampled_from("xy"), st.sampled_from("12"), max_size=2))))
def test_expanding_what_was_compacted(spark, policies):
    d = defaults(spark, ("s", "g", 2, "/*", ["A"]), ("s", "g", 1, "/**", ["B"]), ("t", "g", 1, "/*", ["B"]), ("u", "g", 1, "/*", ["A"]))
    wanted = spark.createDataFrame([(a, "group", "g", p, m) for a, (p, m) in policies.items()], STATE + ", metadata map<string,string>")
    small = policy.compact(wanted, d)
    back = {r.asset: (r.privileges, r.metadata) for r in policy.expand(small, d).collect() if r.privileges}
    assert back == policies
    assert all(r.metadata or r.privileges != {"s": ["A"], "t": ["B"], "u": ["A"]}.get(r.asset) for r in small.collect())


def test_metadata_on_one_side_is_a_difference(spark):
    wanted = spark.createDataFrame([("a", "group", "g", ["X"], {"k": "1"})], STATE + ", metadata map<string,string>")
    row = policy.policy_diff(wanted, state(spark, ("a", "g", ["X"]))).first()
    assert row.change == "modify" and row.add_metadata == {"k": "1"} and row.remove_metadata == {}


def test_missing_policies_become_empty_ones(spark):
    covered = spark.createDataFrame([("schema", "group"), ("schema2", "group")], "asset string, agent string")
    there = spark.createDataFrame([("schema2", "group")], "asset string, agent string")
    assert [r.name for r in policy.non_default_policies(covered, there).collect()] == ["schema-group"]


def test_rename_and_remove(spark):
    folded = spark.createDataFrame([("a", ["u1", "u2"], []), ("b", ["u2"], [])], "asset string, users array<string>, groups array<string>")
    renamed = policy.rename_agent(folded, "users", "u1", "u2")
    assert {r.asset: r.users for r in renamed.collect()} == {"a": ["u2"], "b": ["u2"]}
    assert {r.asset for r in policy.remove_agent(folded, "users", "u2").collect()} == {"a"}


def diffs(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, change string, to_add array<string>, to_remove array<string>")


def test_group_statements(spark):
    plan = warehouse_sql.groups(diffs(spark, ('a"b', "add", ["p"], []), ("c", "remove", [], []), ("d", "modify", ["x"], ["y"])), "ADMIN")
    assert sorted((r.stage, r.statement) for r in plan.collect()) == [
        (0, 'GRANT OWNERSHIP ON ROLE "c" TO "ADMIN";'),
        (1, 'CREATE ROLE "a""b";'),
        (1, 'DROP ROLE "c";'),
        (2, 'GRANT ROLE "p" TO ROLE "a""b";'),
        (2, 'GRANT ROLE "x" TO ROLE "d";'),
        (2, 'REVOKE ROLE "y" FROM ROLE "d";'),
    ]


def test_ownership_is_granted_by_itself(spark):
    d = spark.createDataFrame([("user", "u", "add", ["OWNERSHIP"], []), ("group", "g", "modify", ["OWNERSHIP", "SELECT"], ["INSERT"])], "agent_type string, agent string, change string, to_add array<string>, to_remove array<string>")
    d = d.withColumn("asset_kind", F.lit("TABLE")).withColumn("asset", F.lit('"T"'))
    assert sorted(r.statement for r in warehouse_sql.policies(d).collect()) == [
        'GRANT OWNERSHIP ON TABLE "T" TO ROLE "g" COPY CURRENT GRANTS;',
        'GRANT OWNERSHIP ON TABLE "T" TO USER "u" COPY CURRENT GRANTS;',
        'GRANT SELECT ON TABLE "T" TO ROLE "g";',
        'REVOKE INSERT ON TABLE "T" FROM ROLE "g";',
    ]


def test_requests_are_valid_json(spark):
    d = spark.createDataFrame([("workbook", "7", "user", "u", ["AllowRead", "DenyWrite"], ["AllowFilter"]), ("workbook", "7", "group", "g", ["AllowRead"], [])], "kind string, asset_id string, agent_type string, agent string, to_add array<string>, to_remove array<string>")
    rows = {r.method: r for r in bi_rest.policies(d).collect()}
    body = json.loads(rows["PUT"].body)
    grantees = body["permissions"]["granteeCapabilities"]
    assert len(grantees) == 2 and {len(g["capabilities"]["capability"]) for g in grantees} == {1, 2}
    assert rows["DELETE"].url == "workbooks/7/permissions/users/u/Filter/Allow"
