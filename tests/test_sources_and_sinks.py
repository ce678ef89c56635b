import json

import pytest
from pyspark.sql import functions as F

from grantweave.sinks import export
from grantweave.sources import config_yaml, exports, manifest
from grantweave.streaming.watch import Watcher


def test_manifest(spark, tmp_path):
    node = lambda name, kind="view", **k: {"unique_id": f"model.{name}", "relation_name": None, "resource_type": "model", "config": {"enabled": False, "materialized": kind}, "fqn": ["p", name], "database": "db", "schema": "schema"} | k
    doc = {
        "nodes": {n["unique_id"]: n for n in (node("model"), node("e1", "ephemeral"), node("e2", "ephemeral"), node("child"), node("t", resource_type="test"))},
        "sources": {"source.s": {"relation_name": '"db"."raw"."s"'}},
        "child_map": {"source.s": ["model.model"], "model.model": ["model.e1", "test.t"], "model.e1": ["model.e2"], "model.e2": ["model.child"]},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(doc))
    m = manifest.read(spark, str(tmp_path / "manifest.json"))
    assert {tuple(r) for r in manifest.lineage(m).collect()} == {("db.raw.s", "db.schema.model"), ("db.schema.model", "db.schema.child")}
    refs = {r.cual: (r.enabled, r.derived_to) for r in manifest.references(m, "account").collect()}
    base = "snowflake://account.snowflakecomputing.com/DB"
    assert refs == {f"{base}/SCHEMA/MODEL": (False, [f"{base}/SCHEMA/CHILD"]), f"{base}/SCHEMA/CHILD": (False, []), f"{base}/RAW/S": (None, [f"{base}/SCHEMA/MODEL"])}


def test_configuration_files(spark, tmp_path):
    (tmp_path / "assets").mkdir()
    (tmp_path / "assets/a.yaml").write_text("id: x\nconnector: c\nname: n\npolicies:\n  - users: [u]\n    groups: [g]\n    privileges: [P]\ndefault policies:\n  - path: '/*'\n    target type: table\n    groups: [g]\n    privileges: [Q]\n    connector-managed: true\n")
    assets = config_yaml.assets(spark, str(tmp_path / "assets"))
    assert {(r.asset, r.agent_type, r.agent, r.privileges[0]) for r in config_yaml.policies(assets).collect()} == {("x", "user", "u", "P"), ("x", "group", "g", "P")}
    d = config_yaml.default_policies(assets).first()
    assert (d.root, d.path, d.target_type, d.connector_managed) == ("x", "/*", "table", True)
    (tmp_path / "groups.yaml").write_text("- name: g\n  member of: [h]\n")
    assert config_yaml.groups(spark, str(tmp_path / "groups.yaml")).first().member_of == ["h"]
    (tmp_path / "tags.yaml").write_text("pii:\n  pass_through_lineage: true\n  apply_to: [a1]\n  remove_from: [a2]\n")
    tag = config_yaml.tags(spark, str(tmp_path / "tags.yaml")).first()
    assert (tag.tag, tag.pass_through_lineage, tag.apply_to, tag.remove_from) == ("pii", True, ["a1"], ["a2"])


def test_broken_configuration_files(spark, tmp_path):
    (tmp_path / "fine.yaml").write_text("- name: a\n- name: b\n  groups: [g]\n")
    (tmp_path / "open.yaml").write_text("- name: c\n- name: [x\n- y: 1\n")
    (tmp_path / "tab.yaml").write_text("- name: d\n\tx: 1\n")
    (tmp_path / "mixed.yaml").write_text("- name: e\n- just text\n- groups: []\n- name: f\n")
    (tmp_path / "one.yaml").write_text("name: single\n")
    (tmp_path / "empty.yaml").write_text("")
    found = {(r.file.rsplit("/", 1)[1], r.line, r.column, r.context) for r in config_yaml.problems(spark, str(tmp_path), required=("name",)).collect()}
    assert {x for x in found if x[0] == "mixed.yaml"} == {("mixed.yaml", 2, 3, "- just text"), ("mixed.yaml", 3, 3, "- groups: []")}
    assert {x[:2] for x in found if x[0] != "mixed.yaml"} == {("open.yaml", 3), ("tab.yaml", 2)}
    rows = config_yaml.read(spark, str(tmp_path), config_yaml.USERS, required=("name",), strict=False)
    assert {r.name for r in rows.collect()} == {"a", "b", "e", "f", "single"}
    with pytest.raises(Exception, match=r"open.yaml:3:\d+:|tab.yaml:2:\d+:|mixed.yaml:2:3:"):
        config_yaml.read(spark, str(tmp_path), config_yaml.USERS).collect()
    (tmp_path / "tags").mkdir()
    (tmp_path / "tags" / "t.yaml").write_text("pii:\n  apply_to: [a]\nbad: 3\n")
    assert [r.key for r in config_yaml.read(spark, str(tmp_path / "tags"), config_yaml.TAGS, many=False, strict=False).collect()] == ["pii"]
    assert [(r.line, r.message) for r in config_yaml.problems(spark, str(tmp_path / "tags"), many=False).collect()] == [(3, "expected a mapping")]


def test_warehouse_answers(spark, tmp_path):
    (tmp_path / "roles.json").write_text(json.dumps({"resultSetMetaData": {"rowType": [{"name": "NAME"}, {"name": "OWNER"}]}, "data": [["my_role", None]]}))
    assert [tuple(r) for r in exports.warehouse_rows(spark, str(tmp_path / "roles.json"), ["name", "owner"]).collect()] == [("my_role", "")]


def test_paged_answers(spark, tmp_path):
    for i, name in enumerate(("old", "new")):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"users": {"user": [{"id": "1", "name": name}, {"id": f"x{i}", "name": "n"}]}}))
    found = exports.pages(spark, str(tmp_path), "users.user", "id:string, name:string")
    assert {r.id: r.name for r in found.collect()} == {"1": "new", "x0": "n", "x1": "n"}


def test_permissions_of_the_bi_server(spark):
    caps = [{"group": {"id": "g1"}, "capabilities": {"capability": [{"name": "Read", "mode": "Allow"}, {"name": "InheritedProjectLeader", "mode": "Allow"}]}}]
    answers = spark.createDataFrame([("a", json.dumps(caps))], "asset_id string, granteeCapabilities string")
    users = spark.createDataFrame([("u1", "U")], "id string, name string")
    groups = spark.createDataFrame([("g1", "G")], "id string, name string")
    assert [tuple(r) for r in exports.permissions(answers, users, groups).collect()] == [("a", "group", "G", ["AllowRead"])]


def test_csv_json_dot_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x"y')], "k string, v string")
    export.csv(df, str(tmp_path / "csv"))
    parts = [p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")]
    assert any(t.startswith(b'"k","v"\r\n"a",') for t in parts)
    assert json.loads(export.json(df).first().value) == {"k": "a", "v": 'x"y'}
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [r.line for r in export.dot(edges).collect()] == ["digraph {", '  "a" -> "b";', "}"]
    export.snapshot({t: df for t in ("nodes", "edges", "effective_permissions", "identity_map")}, str(tmp_path / "snap"))
    assert exports.snapshot(spark, str(tmp_path / "snap"))["nodes"].first().k == "a"


def test_watcher_upserts_and_deletes(spark, tmp_path):
    folder = tmp_path / "in"
    write = lambda *rows: spark.createDataFrame(list(rows), "path string, name string, at long, deleted boolean").coalesce(1).write.mode("append").parquet(str(folder))
    write(("a", "one", 1, False), ("b", "two", 1, False))
    watcher = Watcher(spark, "path", "at", str(tmp_path / "state"))
    stream = spark.readStream.schema("path string, name string, at long, deleted boolean").parquet(str(folder))
    watcher.start(stream).awaitTermination()
    write(("a", "uno", 2, False), ("b", "two", 2, True))
    watcher.start(stream).awaitTermination()
    assert {r.path: r.name for r in watcher.state().select("path", "name").collect()} == {"a": "uno"}


def test_table_names_to_cuals(spark):
    tables = spark.createDataFrame([("t1", "d1", "S", "T"), ("t2", "d9", "S", "T")], "table_id string, database_id string, schema string, name string")
    found = exports.table_cuals(tables, spark.createDataFrame([("d1", "s1", "DB")], "id string, server_id string, name string"), spark.createDataFrame([("s1", "host")], "id string, name string"))
    assert [tuple(r) for r in found.collect()] == [("t1", "snowflake://host/DB/S/T")]
    assert exports.lineage(spark.createDataFrame([("w", ["t1", "t2"])], "id string, upstream array<string>"), found).first().derived_from == ["snowflake://host/DB/S/T"]
    assert spark.range(1).select(exports.page_count(F.lit(101), F.lit(100)).alias("n")).first().n == 2
