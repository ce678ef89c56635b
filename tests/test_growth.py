"""Steps that must not repeat work as tables grow: sources are read once, files stay few."""

import json
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from grantweave.llm import suffix_dedup, suffixes
from grantweave.operators import traverse
from grantweave.queries import exchange
from grantweave.sources import config_yaml, manifest


def ticking(df):
    """The same table, and a counter of the rows that were worked out."""
    spark = df.sparkSession
    counter = spark.sparkContext.accumulator(0)
    schema = df.schema

    def tick(row):
        counter.add(1)
        return row

    return spark.createDataFrame(df.rdd.map(tick), schema), counter


def small_manifest(spark):
    """A source that feeds an ephemeral model, which feeds two relations."""
    node = lambda name, kind: f"('m.{name}', named_struct('unique_id', 'm.{name}', 'relation_name', 'db.s.{name}', 'resource_type', 'model', 'config', named_struct('enabled', true, 'materialized', '{kind}'), 'fqn', array('x'), 'database', 'db', 'schema', 's', 'description', null, 'tags', null))"
    entry = lambda t: t.replace("('m.", "struct('m.", 1)
    nodes = ", ".join(entry(node(n, k)) for n, k in (("e", "ephemeral"), ("a", "table"), ("b", "table")))
    text = f"SELECT map_from_entries(array({nodes})) AS nodes, map('src.s', named_struct('relation_name', 'raw.s.s')) AS sources, map('src.s', array('m.e', 'm.a'), 'm.e', array('m.a', 'm.b')) AS child_map"
    return spark.createDataFrame(spark.sql(text).collect(), manifest.SCHEMA)


def test_lineage_reads_its_manifest_once(spark):
    found, counter = ticking(small_manifest(spark))
    assert sorted(map(tuple, manifest.lineage(found).collect())) == [("raw.s.s", "db.s.a"), ("raw.s.s", "db.s.b")]
    assert counter.value == 1


def test_references_read_their_manifest_once(spark):
    found, counter = ticking(small_manifest(spark))
    base = "snowflake://acct.snowflakecomputing.com/"
    refs = {r.cual: r.derived_to for r in manifest.references(found, "acct").collect()}
    assert refs == {base + "RAW/S/S": [base + "DB/S/A", base + "DB/S/B"], base + "DB/S/A": [], base + "DB/S/B": []}
    assert counter.value == 1


class Parts:
    def __init__(self, spark):
        self.spark = spark
        self.part = spark.range(3000).selectExpr("id AS p_partkey", "concat('Brand#', id % 5) AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 AS INT) AS p_size")
        self.supplier = spark.range(400).selectExpr("id AS s_suppkey")
        self.lineitem = spark.range(4000).selectExpr("id % 400 AS l_suppkey", "id % 3000 AS l_partkey")


def test_manifests_of_many_documents_are_few_files(spark):
    t = Parts(spark)
    found = exchange.part_manifest(t)
    documents = found.count()
    assert documents == 3 * 6 + 1 + 1 + 20
    assert len(found.inputFiles()) < documents
    dsts = {r.src: r.dsts.split(",") for r in exchange.op_s07_child_map(t).collect()}
    expected = {}
    for x in t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).collect():
        to = f"db.brands.{x.p_brand}" if x.p_size > 40 else f"db.LARGE.p{x.p_partkey}"
        expected.setdefault(f"raw.s.{x.l_suppkey}", set()).add(to)
    assert {k: v for k, v in dsts.items() if k.startswith("raw.")} == {k: sorted(v) for k, v in expected.items()}


def test_contraction_works_out_its_arcs_once(spark):
    pairs = [("a", "e"), ("a", "b"), ("e", "f"), ("f", "e"), ("f", "c"), ("e", "a"), ("b", "c"), ("a", "e"), ("g", None), (None, "b")]
    found, counter = ticking(spark.createDataFrame(pairs, "src string, dst string"))
    rows = traverse.contract(found, spark.createDataFrame([("e",), ("f",)], "node string")).collect()
    assert sorted((r.src, r.dst or "") for r in rows) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "c"), ("g", "")]
    assert counter.value == len(pairs)


def test_parsing_a_list_holds_one_entry_at_a_time():
    text = "".join(f"- name: user{i}\n" for i in range(3000))
    config_yaml.parse("- name: a\n", True, [])
    tracemalloc.start()
    found, problems = config_yaml.parse(text, True, ["name"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert json.loads(found) == [{"name": f"user{i}"} for i in range(3000)] and not problems
    assert peak < 40 * len(text)


def test_entries_of_a_broken_list_are_left_out():
    assert config_yaml.parse("- name: a\n- groups: [g]\n- name: [\n", True, ["name"])[0] is None
    assert [p["line"] for p in config_yaml.parse("- groups: [g]\n--- \n- name: b\n", True, ["name"])[1]] == [2]
    assert json.loads(config_yaml.parse("- &x {name: a}\n- {<<: *x, k: 1}\n", True, [])[0]) == [{"name": "a"}, {"name": "a", "k": 1}]


def test_runs_of_a_shard_are_found_together(monkeypatch):
    calls, runs_of = [], suffix_dedup.runs_of
    monkeypatch.setattr(suffix_dedup, "runs_of", lambda flags: calls.append(1) or runs_of(flags))
    found = suffix_dedup.repeated_windows([b"abcdab", b"xbcdx", b"ab", b"q", b"zzzz"], np.array([1, 1, 2, 1, 1]), 2)
    assert found == [[(0, 3), (4, 1)], [(1, 2)], [(0, 1)], [], [(0, 3)]]
    assert len(calls) == 1


def test_whole_numbers_are_sorted_with_their_places():
    for key in (np.array([], np.int64), np.array([3, 0, 3, 1, 0]), np.array([1 << 61, 0, 1 << 62, 1 << 61])):
        assert suffixes.sorting(key).tolist() == np.argsort(key, kind="stable").tolist()
