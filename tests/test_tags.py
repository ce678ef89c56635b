import random
from itertools import product

import pytest

from pyspark.sql import functions as F

from grantweave.operators import tags


def tables(spark, flags, applied, removed, hierarchy, lineage):
    pair = lambda rows, names: spark.createDataFrame(rows, names)
    return (
        pair(flags, "tag string, pass_through_hierarchy boolean, pass_through_lineage boolean"),
        pair(applied, "tag string, asset string"),
        pair(removed, "tag string, asset string"),
        pair(hierarchy, "src string, dst string"),
        pair(lineage, "src string, dst string"),
    )


GOLDEN = (
    [("tag1", True, False), ("tag2", False, True), ("tag3", True, True), ("tag4", False, False)],
    [(f"tag{i}", "1") for i in range(1, 5)],
    [(t, a) for t in ("tag1", "tag2") for a in ("5", "6")],
    [("1", "4"), ("4", "6"), ("6", "8")],
    [("1", "3"), ("3", "5"), ("5", "7")],
)


def test_golden(spark):
    found = tags.assets_for_tags(*tables(spark, *GOLDEN)).collect()
    count = lambda t: tuple(sum(r.tag == t and r.via == v for r in found) for v in ("direct", "hierarchy", "lineage", "untagged"))
    assert [count(f"tag{i}") for i in range(1, 5)] == [(1, 1, 0, 2), (1, 0, 1, 2), (1, 3, 3, 0), (1, 0, 0, 0)]
    per_asset = {}
    for r in tags.all_tags(*tables(spark, *GOLDEN)).collect():
        per_asset[r.asset] = per_asset.get(r.asset, 0) + 1
    assert per_asset == {"1": 4, "3": 2, "4": 2, "5": 1, "6": 1, "7": 1, "8": 1}


def by_enumeration(flags, applied, removed, hierarchy, lineage):
    out = set()
    for tag, h, l in flags:
        bad = {a for t, a in removed if t == tag}
        bases = {a for t, a in applied if t == tag} - bad
        out |= {(tag, a, "direct") for a in bases} | {(tag, a, "untagged") for a in bad}
        for flag, edges, via in ((h, hierarchy, "hierarchy"), (l, lineage, "lineage")):
            todo = [[b] for b in bases] if flag else []
            while todo:
                path = todo.pop()
                for s, d in edges:
                    if s == path[-1] and d not in path:
                        if not bad & {*path, d}:
                            out.add((tag, d, via))
                        todo.append([*path, d])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reachability_equals_enumeration(spark, seed):
    rng = random.Random(seed)
    nodes = [f"a{i}" for i in range(6)]
    some = lambda n: list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(n)})
    flags = [(f"t{i}{j}", bool(i), bool(j)) for i, j in product((0, 1), repeat=2)]
    names = [f[0] for f in flags]
    args = (flags, list({(rng.choice(names), rng.choice(nodes)) for _ in range(8)}), list({(rng.choice(names), rng.choice(nodes)) for _ in range(4)}), [e for e in some(8) if e[0] != e[1]], [e for e in some(8) if e[0] != e[1]])
    found = {tuple(r) for r in tags.assets_for_tags(*tables(spark, *args)).collect()}
    assert found == by_enumeration(*args)
    paths = {(r.tag, r.asset) for r in tags.tag_paths(*tables(spark, *args)).collect()}
    assert paths == {(t, a) for t, a, via in found if via != "untagged"}


def test_target_matching(spark):
    target = lambda *rows: spark.createDataFrame(rows, "pattern string, kind string")
    assets = lambda *names: spark.createDataFrame([(n, "table") for n in names], "asset string, kind string")
    one = lambda t, a: [(r.asset, r.outcome) for r in tags.match_targets(t, a).collect()]
    assert one(target(("asset", None)), assets("cn1::my_asset", "cn2::asset")) == [(None, "too many")]
    assert one(target(("a", None)), assets("::a", "::b")) == [("::a", "matched")]
    assert one(target(("A", None)), assets("::a", "::b")) == [("::a", "matched")]
    assert one(target(("b", "view")), assets("::a", "::b")) == [(None, "bad type")]
    assert one(target(("zz", None)), assets("::a")) == [(None, "no match")]


def test_thousands_of_patterns_in_one_pass(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names = sorted({word(rng.randrange(3, 14)) for _ in range(400)})
    patterns = sorted({word(rng.randrange(1, 7)) for _ in range(1500)} | {""})
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "low string").withColumn("extra", F.lit(1))
    expected = {(n, p) for n in names for p in patterns if p in n}
    for most in (100_000, 300):
        found = tags.containing(df, "low", spark.createDataFrame([(p,) for p in patterns] + [(None,)], "key string"), most)
        rows = [(r.low, r.key) for r in found.collect()]
        assert set(rows) == expected and len(rows) == len(expected)
    assets = spark.createDataFrame([(n, "t") for n in names], "asset string, kind string")
    targets = spark.createDataFrame([(p, k) for p in patterns for k in (None, "t", "v")], "pattern string, kind string")
    plan = tags.match_targets(targets, assets)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
