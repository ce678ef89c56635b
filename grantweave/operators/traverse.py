"""Traversal of the access graph as joins.

Edges and start nodes are DataFrames; keys are plain columns (``src``, ``dst``, ``source``), so one traversal serves any
number of start nodes. Reachability keeps the pairs seen and joins only the new frontier; enumeration carries the
path as an array and never visits a node twice. Every hop is stored, so plans stay short and lost executors are
cheap; Catalyst picks broadcast or shuffled joins by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Hops after which their results are stored as one table.
MERGED = 5
#: Paths that an enumeration may walk.
MOST = 1_000_000_000


def arcs(edges: DataFrame, *types: str) -> DataFrame:
    """(src, dst) of the given edge types of a full edge table; keys join type and id."""
    key = lambda side: F.concat_ws(":", f"{side}_type", f"{side}_id")
    kept = edges.where(F.col("edge_type").isin(*types)) if types else edges
    return kept.select(key("src").alias("src"), key("dst").alias("dst"))


def reach(arcs: DataFrame, sources: DataFrame, passthrough: DataFrame | None = None, target: DataFrame | None = None, min_depth: int = 1, max_depth: int | None = None) -> DataFrame:
    """(source, node, depth): nodes within reach of each source, at their least depth.

    ``passthrough`` and ``target`` are tables of a column ``node``: only the former are walked through, only the latter are
    returned. Sources aren't visited beforehand, so one on a cycle is returned too.
    """
    arcs = arcs.select("src", "dst").distinct()
    through = arcs if passthrough is None else arcs.join(passthrough.select(F.col("node").alias("src")), "src", "left_semi")
    frontier = stored(sources.select("source", F.col("source").alias("node")).distinct().join(arcs.withColumnRenamed("src", "node"), "node").select("source", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct())
    levels, depth = [frontier], 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        seen = reduce(DataFrame.union, levels).select("source", "node")
        step = frontier.join(through.withColumnRenamed("src", "node"), "node").select("source", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        # what was seen is read again at every hop: few files instead of a growing union
        levels = [stored(reduce(DataFrame.union, levels)), frontier] if len(levels) == MERGED else [*levels, frontier]
    found = reduce(DataFrame.union, levels).where(F.col("depth") >= min_depth)
    return found if target is None else found.join(target.select("node"), "node", "left_semi").select("source", "node", "depth")


def hop(arcs: DataFrame, sources: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """(source, node): direct neighbours."""
    found = sources.select("source", F.col("source").alias("src")).join(arcs, "src").select("source", F.col("dst").alias("node")).distinct()
    return found if target is None else found.join(target.select("node"), "node", "left_semi").select("source", "node")


def paths(arcs: DataFrame, sources: DataFrame, passthrough: DataFrame | None = None, target: DataFrame | None = None, stop: DataFrame | None = None, min_depth: int = 1, max_depth: int | None = None, most: int = MOST, useful: DataFrame | None = None) -> DataFrame:
    """(source, node, path, depth): all simple paths, ends included, to every target.

    Their number can grow without bound where nodes have many ways to each other: more than ``most`` are an error, never a cut.
    ``stop`` (source, node): a path that meets its source's stop node ends there, and only such paths are returned.
    ``useful`` (source, node, left): the nodes that a source's paths may enter, with the hops they need from there at least; no step to another node, or
    to one too far for ``max_depth``, is stored.
    """
    arcs = arcs.select("src", "dst").distinct()
    through = None if passthrough is None else passthrough.select("node").distinct()
    frontier = sources.select("source", F.col("source").alias("node"), F.array("source").alias("path")).distinct()
    found, depth, walked = [], 0, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(arcs.withColumnRenamed("src", "node"), "node").where(~F.array_contains("path", F.col("dst")))
        step = step.select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        if useful is not None:
            near = useful if max_depth is None else useful.where(F.col("left") <= max_depth - depth)
            step = step.join(near.select("source", "node"), ["source", "node"], "left_semi")
        if stop is not None:
            ends = stop.select("source", "node", F.lit(True).alias("ends"))
            step = step.join(ends, ["source", "node"], "left")
        step = stored(step)
        n = step.count()  # read from the files' footers
        walked += n
        if walked > most:
            raise ValueError(f"more than {most} paths; restrict the sources or the depth")
        if not n:
            break
        if stop is not None:
            hit = step.where("ends").drop("ends")
            step = step.where("ends IS NULL").drop("ends")
        else:
            hit = step
        if depth >= min_depth:
            found.append(hit.withColumn("depth", F.lit(depth)))
        frontier = step if through is None else step.join(through, "node", "left_semi").select("source", "node", "path")
    if not found:
        return frontier.withColumn("depth", F.lit(0)).where("false")
    every = reduce(DataFrame.unionByName, found)
    return every if target is None else every.join(target.select("node"), "node", "left_semi").select("source", "node", "path", "depth")


def paths_between(arcs: DataFrame, pairs: DataFrame, passthrough: DataFrame | None = None, min_depth: int = 1, max_depth: int | None = None) -> DataFrame:
    """All simple paths from ``source`` to ``node`` for each pair; a path ends at its first visit.

    The hops from every node to the targets are found first, against the arcs, so paths only enter nodes from which their source's target
    can still be reached in time.
    """
    pairs = pairs.select("source", "node").distinct()
    back = reach(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pairs.select(F.col("node").alias("source")).distinct(), passthrough, max_depth=max_depth)
    ends = pairs.select("source", "node", F.lit(0).alias("left"))
    before = pairs.withColumnRenamed("node", "end").join(back.select(F.col("source").alias("end"), "node", F.col("depth").alias("left")), "end").select("source", "node", "left")
    useful = stored(ends.union(before).groupBy("source", "node").agg(F.min("left").alias("left")))
    return paths(arcs, pairs.select("source"), passthrough, None, pairs, min_depth, max_depth, useful=useful)


def subgraph(arcs: DataFrame, centre: Column | str, max_depth: int) -> DataFrame:
    """(src, dst): distinct edges met within ``max_depth`` undirected hops of one node."""
    both = arcs.select("src", "dst").union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = arcs.sparkSession.range(1).select(F.lit(centre).alias("source"))
    inner = near.select(F.col("source").alias("node"))
    if max_depth > 1:
        inner = inner.union(reach(both, near, max_depth=max_depth - 1).select("node")).distinct()
    kept = arcs.select("src", "dst").distinct()
    touching = lambda end: kept.join(inner.select(F.col("node").alias(end)), end, "left_semi").select("src", "dst")
    return touching("src").union(touching("dst")).distinct()


def default_targets(parents: DataFrame, policies: DataFrame, kinds: DataFrame) -> DataFrame:
    """(policy columns, node): assets below each default policy's root that its wildcard and target type cover.

    ``parents``: (src, dst) parent to child; ``policies`` have root, path and target_type; ``kinds``: (node, kind).
    """
    from ..functions.paths import wildcard

    depth, endless = wildcard(F.col("path"))
    p = policies.withColumn("least", depth).withColumn("endless", endless)
    below = reach(parents, p.select(F.col("root").alias("source")))
    covered = p.join(below.withColumnRenamed("source", "root"), "root").where((F.col("depth") == F.col("least")) | F.col("endless") & (F.col("depth") >= F.col("least")))
    return covered.join(kinds, (covered["node"] == kinds["node"]) & (covered["target_type"] == kinds["kind"])).select(*[covered[c] for c in policies.columns], covered["node"])


def ancestor_chain(parent_of: DataFrame) -> DataFrame:
    """(node, chain): ancestors of each node of (child, parent), the nearest first; roots have an empty chain. Of several parents the least
    counts; on a cycle a chain ends before it meets a node again.

    Chains double: with 2^k ancestors known, the chain of the last of them is put on, so rounds are the logarithm of the depth. Only
    chains that may go on are looked up.
    """
    up = parent_of.where("child IS NOT NULL AND parent IS NOT NULL").groupBy("child").agg(F.min("parent").alias("parent"))
    chains = stored(up.select(F.col("child").alias("node"), F.when(F.col("child") == F.col("parent"), F.array().cast("array<string>")).otherwise(F.array("parent")).alias("chain"), (F.col("child") != F.col("parent")).alias("open")))
    while not chains.where("open").isEmpty():
        further = chains.select(F.col("node").alias("last"), F.col("chain").alias("more"), F.col("open").alias("further"))
        grown = chains.where("open").withColumn("last", F.element_at("chain", -1)).join(further, "last", "left")
        whole = F.concat(F.array("node"), "chain", F.coalesce("more", F.array().cast("array<string>")))
        grown = grown.select("node", whole.alias("whole"), F.array_distinct(whole).alias("once"), F.coalesce("further", F.lit(False)).alias("further"))
        grown = grown.select("node", F.slice("once", 2, 1 << 30).alias("chain"), (F.col("further") & (F.size("once") == F.size("whole"))).alias("open"))
        chains = stored(chains.where("NOT open").union(grown))
    every = parent_of.select(F.col("child").alias("node")).union(parent_of.select(F.col("parent").alias("node"))).where("node IS NOT NULL").distinct()
    return every.join(chains.select("node", "chain"), "node", "left").select("node", F.coalesce("chain", F.array().cast("array<string>")).alias("chain"))


def contract(arcs: DataFrame, ephemeral: DataFrame) -> DataFrame:
    """(src, dst) between lasting nodes, with chains of ephemeral ones (column node) replaced by direct edges."""
    inner = stored(ephemeral.select("node").distinct())
    known = lambda c, flag: inner.select(F.col("node").alias(c), F.lit(True).alias(flag))
    marked = arcs.select("src", "dst").join(known("src", "leaves_inner"), "src", "left").join(known("dst", "meets_inner"), "dst", "left")
    return contract_marked(marked)


def contract_marked(arcs: DataFrame) -> DataFrame:
    """As ``contract``, of (src, dst, leaves_inner, meets_inner): the flags (null: false) tell which ends are ephemeral. Arcs between lasting nodes are results as they stand; only pairs that end at an ephemeral node are walked on and remembered."""
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    arcs = stored(arcs.where("src IS NOT NULL").select("src", "dst", flag("leaves_inner"), flag("meets_inner")))
    starts, through = arcs.where("NOT leaves_inner"), arcs.where("leaves_inner").select(F.col("src").alias("node"), "dst", "meets_inner")
    found = [starts.where("NOT meets_inner").select("src", "dst")]
    frontier = stored(starts.where("meets_inner").select("src", F.col("dst").alias("node")).distinct())
    seen = [frontier]
    while not frontier.isEmpty():
        step = stored(frontier.join(through, "node").select("src", "dst", "meets_inner"))
        found.append(step.where("NOT meets_inner").select("src", "dst"))
        ahead = step.where("meets_inner").select("src", F.col("dst").alias("node")).distinct()
        frontier = stored(ahead.join(reduce(DataFrame.union, seen), ["src", "node"], "left_anti"))
        seen = [stored(reduce(DataFrame.union, seen)), frontier] if len(seen) == MERGED else [*seen, frontier]
    return reduce(DataFrame.union, found).distinct()
