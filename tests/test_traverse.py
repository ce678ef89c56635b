"""Goldens of small hand-made graphs, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from grantweave.operators import traverse

GROUPS = [("user", "g1"), ("user", "g2"), ("g2", "g1"), ("g2", "g3"), ("g2", "g4"), ("g3", "g4"), ("g4", "g1")]


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, *names, column="node"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def start(spark, *names):
    return nodes(spark, *names, column="source")


def test_start_is_returned_on_a_cycle(spark):
    both = [("user", "policy"), ("policy", "user"), ("policy", "asset"), ("asset", "policy")]
    found = traverse.reach(arcs(spark, both), start(spark, "user"))
    assert {r.node for r in found.collect()} == {"user", "policy", "asset"}


def test_passthrough_and_target(spark):
    g = arcs(spark, [("user", "policy"), ("policy", "asset")])
    count = lambda **k: traverse.reach(g, start(spark, "user"), **k).count()
    assert count(target=nodes(spark, "asset")) == 1
    assert count(target=nodes(spark, "asset"), passthrough=nodes(spark, "policy")) == 1
    assert count(target=nodes(spark, "asset"), passthrough=nodes(spark, "user")) == 0


@pytest.mark.parametrize(("least", "most", "expected"), [(1, None, 4), (2, 3, 2), (2, 2, 1)])
def test_paths_between(spark, least, most, expected):
    pair = start(spark, "user").withColumn("node", F.lit("g1"))
    assert traverse.paths_between(arcs(spark, GROUPS), pair, None, least, most).count() == expected


def test_paths_through_one_group(spark):
    pair = start(spark, "user").withColumn("node", F.lit("g1"))
    assert traverse.paths_between(arcs(spark, GROUPS), pair, nodes(spark, "g2")).count() == 2


def test_paths_never_return_to_their_start(spark):
    pair = start(spark, "g1").withColumn("node", F.lit("g1"))
    assert traverse.paths_between(arcs(spark, [*GROUPS, ("g1", "user")]), pair).count() == 0


def test_paths_to_descendants(spark):
    every = [*GROUPS, *[(b, a) for a, b in GROUPS]]
    found = traverse.paths(arcs(spark, GROUPS), start(spark, "user"))
    assert found.select("node").distinct().count() == 4
    assert traverse.paths(arcs(spark, every), start(spark, "user"), target=nodes(spark, "g4")).count() == 6


def test_subgraph_is_a_star_at_depth_one(spark):
    found = {(r.src, r.dst) for r in traverse.subgraph(arcs(spark, GROUPS), "g3", 1).collect()}
    assert found == {("g2", "g3"), ("g3", "g4")}


def test_ancestor_chain(spark):
    rows = spark.createDataFrame([("p2", "p1"), ("p1", "p0")], "child string, parent string")
    chain = {r.node: r.chain for r in traverse.ancestor_chain(rows).collect()}
    assert chain == {"p2": ["p1", "p0"], "p1": ["p0"], "p0": []}


def test_contraction(spark):
    found = traverse.contract(arcs(spark, [("parent", "e1"), ("e1", "e2"), ("e2", "child")]), nodes(spark, "e1", "e2"))
    assert [tuple(r) for r in found.collect()] == [("parent", "child")]


def test_empty_graph(spark):
    empty = arcs(spark, [])
    assert traverse.reach(empty, start(spark, "a")).count() == 0
    assert traverse.paths(empty, start(spark, "a")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_reach_agrees_with_paths(spark, seed):
    rng = random.Random(seed)
    pairs = list({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(12)})
    g = arcs(spark, [p for p in pairs if p[0] != p[1]])
    sources = start(spark, "n0", "n1", "n2")
    by_paths = {(r.source, r.node) for r in traverse.paths(g, sources).collect()}
    reached = {(r.source, r.node): r.depth for r in traverse.reach(g, sources).collect()}
    assert by_paths == {k for k in reached if k[0] != k[1]}
    shortest = {}
    for r in traverse.paths(g, sources).collect():
        shortest[r.source, r.node] = min(r.depth, shortest.get((r.source, r.node), 99))
    assert all(reached[k] == d for k, d in shortest.items())


def test_paths_do_not_enter_dead_ends(spark, monkeypatch):
    trunk = [("s", "a"), ("a", "b"), ("b", "t")]
    dead = [("s", f"x{i}") for i in range(20)] + [(f"x{i}", f"y{j}") for i in range(20) for j in range(20)] + [("t", "z"), ("z", "z2")]
    steps, keep = [], traverse.stored

    def counted(df):
        out = keep(df)
        if "path" in out.columns:
            steps.append(out.count())
        return out

    monkeypatch.setattr(traverse, "stored", counted)
    pairs = spark.createDataFrame([("s", "t")], "source string, node string")
    found = traverse.paths_between(arcs(spark, trunk + dead), pairs)
    assert [r.path for r in found.collect()] == [["s", "a", "b", "t"]]
    assert sum(steps) == 3
    steps.clear()
    assert traverse.paths_between(arcs(spark, trunk + dead), pairs, max_depth=2).count() == 0
    assert sum(steps) == 0  # the first step is too far from the target already


def test_paths_between_on_random_graphs(spark):
    rng = random.Random(8)
    for _ in range(3):
        names = "abcdefg"
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(12)})
        inner = [n for n in names if rng.random() < 0.7]
        ends = [("a", "e"), ("a", "f"), ("b", "a")]

        def walk(path, stops, pairs=pairs, inner=inner):
            for s, d in pairs:
                if s == path[-1] and d not in path:
                    if d in stops:
                        yield (*path, d)
                    elif d in inner:
                        yield from walk((*path, d), stops)

        expected = {p for s in {s for s, _ in ends} for p in walk((s,), {e for x, e in ends if x == s}) if len(p) <= 5}
        found = traverse.paths_between(arcs(spark, pairs), spark.createDataFrame(ends, "source string, node string"), nodes(spark, *inner), max_depth=4)
        assert {tuple(r.path) for r in found.collect()} == expected


def test_chains_double(spark, monkeypatch):
    rounds, keep = [], traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df: rounds.append(1) or keep(df))
    depth = 40
    rows = [(f"n{i + 1}", f"n{i}") for i in range(depth)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("into", "c1"), ("self", "self"), ("two", "n5"), ("two", "n3"), (None, "n1"), ("n0", None)]
    chain = {r.node: r.chain for r in traverse.ancestor_chain(spark.createDataFrame(rows, "child string, parent string")).collect()}
    assert all(chain[f"n{i}"] == [f"n{j}" for j in range(i - 1, -1, -1)] for i in range(depth + 1))
    assert chain["c1"] == ["c2", "c3"] and chain["into"] == ["c1", "c2", "c3"] and chain["self"] == [] and chain["two"] == ["n3", "n2", "n1", "n0"]
    assert len(rounds) <= 8  # 40 ancestors: 1, 2, 4, ... 64
