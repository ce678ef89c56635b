"""Queries of single operators read all rows of their tables."""

import pytest
from pyspark.sql import functions as F

from grantweave.operators import explore
from grantweave.queries import governance, graph
from grantweave.schemas import NODE_ORDER


class Small:
    """A few rows of the star schema, with keys that a modulo, a line number or a first page would leave out."""

    def __init__(self, spark):
        self.spark = spark
        self.customer = spark.createDataFrame([(i, f"c{i % 70:03}") for i in range(130)], "c_custkey long, c_name string")
        self.nation = spark.createDataFrame([(i, f"n{i}") for i in range(3)], "n_nationkey long, n_name string")
        self.region = spark.createDataFrame([(i, f"r{i}") for i in range(2)], "r_regionkey long, r_name string")
        self.supplier = spark.createDataFrame([(i, f"s{i}") for i in range(40)], "s_suppkey long, s_name string")
        self.part = spark.createDataFrame([(i, f"p{i}", "t") for i in range(1, 8)], "p_partkey long, p_name string, p_type string")
        self.orders = spark.createDataFrame([(i, i) for i in range(10)], "o_orderkey long, o_custkey long")
        self.lineitem = spark.createDataFrame([(o, n, 10 * o + n, 10 + n, "A") for o in range(10) for n in range(1, 6)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")

    def sql(self, text):
        return self.spark.sql(text, **{n: d for n, d in vars(self).items() if n != "spark" and "{" + n + "}" in text})


@pytest.fixture(scope="module")
def t(spark):
    return Small(spark)


def test_all_nodes_get_their_place(t):
    rows = [(r.node_type, r.name) for r in graph.node_table(t).collect()]
    expected = sorted(rows, key=lambda r: (NODE_ORDER.index(r[0]), r[1]))
    found = sorted(graph.op_r01_sorted_nodes(t).collect(), key=lambda r: r.place)
    assert [(r.node_type, r.name) for r in found] == expected and [r.place for r in found] == list(range(1, len(rows) + 1))
    assert explore.placed(graph.node_table(t).where(F.lit(False))).count() == 0


def test_all_lines_are_contracted(t):
    expected = {(f"customer:{o}", f"part:{10 * o + n}") for o in range(10) for n in range(1, 6)}
    assert {tuple(r) for r in graph.op_s06_contraction(t).collect()} == expected


def test_all_references_are_resolved(t):
    assert {tuple(r) for r in graph.op_j04_edge_resolution(t).collect()} == {(f"r{i}", i) for i in range(1, 8)}


def test_all_policies_are_folded(t):
    found = {r.asset: r.users for r in governance.op_a10_fold_policies(t).collect()}
    assert found == {f"customer:{o}": ",".join(f"user:{10 + n}" for n in range(1, 6)) for o in range(10)}
    assert {r.asset for r in governance.op_m13_rename_remove(t).collect()} == set(found)
