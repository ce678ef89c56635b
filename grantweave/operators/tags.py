"""Tags on assets: direct ones, those inherited by hierarchy or lineage, and removals.

A tag reaches an asset along hierarchy only, or along lineage only, if its flag allows that, and never through or to an
asset it was removed from. Which assets a tag reaches needs no path enumeration: (tag, base) pairs, base being a
directly tagged asset, walk a graph without the removed assets, and a base is never its own heir.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .traverse import MERGED, paths, reach

#: Patterns that one automaton holds.
SLICE = 100_000


def spread(arcs: DataFrame, bases: DataFrame, removed: DataFrame) -> DataFrame:
    """(tag, base, asset) for every asset that (tag, base) reaches without touching the tag's removed assets."""
    frontier = stored(bases.select("tag", "base", F.col("base").alias("asset")))
    levels = [frontier]
    while not frontier.isEmpty():
        seen = reduce(DataFrame.union, levels)
        step = frontier.join(arcs.withColumnRenamed("src", "asset"), "asset").select("tag", "base", F.col("dst").alias("asset")).distinct()
        frontier = stored(step.join(removed, ["tag", "asset"], "left_anti").join(seen, ["tag", "base", "asset"], "left_anti"))
        levels = [stored(seen), frontier] if len(levels) == MERGED else [*levels, frontier]
    return reduce(DataFrame.union, levels).where("asset != base")


def assets_for_tags(tags: DataFrame, applied: DataFrame, removed: DataFrame, hierarchy: DataFrame, lineage: DataFrame) -> DataFrame:
    """(tag, asset, via), via being direct, hierarchy, lineage or untagged.

    ``tags``: (tag, pass_through_hierarchy, pass_through_lineage); ``applied`` and ``removed``: (tag, asset);
    ``hierarchy`` and ``lineage``: (src, dst) from parent to child and from origin to derived.
    """
    removed = stored(removed.select("tag", "asset").distinct())
    bases = stored(applied.select("tag", "asset").distinct().join(removed, ["tag", "asset"], "left_anti"))
    direct = bases.join(tags.select("tag"), "tag", "left_semi").select("tag", "asset", F.lit("direct").alias("via"))

    def inherited(flag: str, arcs: DataFrame, via: str) -> DataFrame:
        own = bases.join(tags.where(flag).select("tag"), "tag", "left_semi").withColumnRenamed("asset", "base")
        return spread(arcs.select("src", "dst").distinct(), own, removed).select("tag", "asset", F.lit(via).alias("via")).distinct()

    found = direct.union(inherited("pass_through_hierarchy", hierarchy, "hierarchy")).union(inherited("pass_through_lineage", lineage, "lineage"))
    return found.union(removed.join(tags.select("tag"), "tag", "left_semi").select("tag", "asset", F.lit("untagged").alias("via")))


def tags_for_assets(*tables: DataFrame) -> DataFrame:
    """(asset, tag, via): the same relation seen from the assets, without removals."""
    return assets_for_tags(*tables).where("via != 'untagged'").select("asset", "tag", "via")


def towards(assets: DataFrame, tags: DataFrame, applied: DataFrame, removed: DataFrame, hierarchy: DataFrame, lineage: DataFrame) -> tuple[DataFrame, ...]:
    """The tag tables cut down to what can decide the tags of some assets (column asset): they themselves and what lies above them."""
    above = {}
    for name, arcs in (("hierarchy", hierarchy), ("lineage", lineage)):
        up = reach(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), assets.select(F.col("asset").alias("source")))
        above[name] = stored(up.select("node").union(assets.select("asset")).distinct())
    every = above["hierarchy"].union(above["lineage"]).distinct().withColumnRenamed("node", "asset")
    inner = lambda arcs, name: arcs.join(above[name].withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    near = lambda df: df.join(every, "asset", "left_semi").select("tag", "asset")
    return tags, near(applied), near(removed), inner(hierarchy, "hierarchy"), inner(lineage, "lineage")


def of_tag(tag: str, tags: DataFrame, applied: DataFrame, removed: DataFrame, hierarchy: DataFrame, lineage: DataFrame) -> tuple[DataFrame, ...]:
    """The tag tables cut down to one tag."""
    mine = lambda df: df.where(F.col("tag") == tag)
    return mine(tags), mine(applied), mine(removed), hierarchy, lineage


def all_tags(*tables: DataFrame) -> DataFrame:
    """(asset, tag), whatever the way."""
    return tags_for_assets(*tables).select("asset", "tag").distinct()


def tag_paths(tags: DataFrame, applied: DataFrame, removed: DataFrame, hierarchy: DataFrame, lineage: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(tag, asset, path): the simple paths from tag to asset along which it is inherited, direct tags included."""
    mark = lambda c: F.concat(F.lit("tag:"), c)
    direct = applied.select("tag", "asset").distinct().join(removed.select("tag", "asset"), ["tag", "asset"], "left_anti")
    found = direct.select("tag", "asset", F.array("asset").alias("path"))
    for flag, arcs in (("pass_through_hierarchy", hierarchy), ("pass_through_lineage", lineage)):
        own = direct.join(tags.where(flag).select("tag"), "tag", "left_semi")
        walked = paths(arcs, own.select(F.col("asset").alias("source")).distinct(), max_depth=max_depth)
        found = found.union(own.withColumnRenamed("asset", "source").join(walked, "source").select("tag", F.col("node").alias("asset"), "path"))
    poison = removed.groupBy("tag").agg(F.collect_set("asset").alias("poison"))
    clean = found.join(poison, "tag", "left").where(F.col("poison").isNull() | ~F.arrays_overlap("path", "poison"))
    return clean.select("tag", "asset", F.concat(F.array(mark(F.col("tag"))), "path").alias("path")).distinct()


def containing(names: DataFrame, column: str, patterns: DataFrame, most: int = SLICE) -> DataFrame:
    """``names`` once for each of the patterns (column key) that its ``column`` contains, with that key.

    Patterns are taken in slices of about ``most``; a slice is a trie with failure links (Aho-Corasick) in each task, which reads
    every name once, whatever the number of patterns. An empty pattern is in every name; null names and patterns match nothing.
    """
    spark = names.sparkSession
    known = stored(patterns.where("key IS NOT NULL").distinct())
    slices = max(1, -(-known.count() // most))
    schema = names.withColumn("key", F.lit("")).schema
    found = []
    for i in range(slices):
        held = spark.sparkContext.broadcast([r.key for r in known.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == i).collect()])

        def search(batches, held=held):
            import ahocorasick

            trie, always = ahocorasick.Automaton(), [k for k in held.value if not k]
            for k in held.value:
                if k:
                    trie.add_word(k, k)
            if len(trie):
                trie.make_automaton()
            for b in batches:
                at, keys = [], []
                for place, text in enumerate(b[column]):
                    if text is not None:
                        hits = {*always, *(k for _, k in trie.iter(text))} if len(trie) else set(always)
                        at += [place] * len(hits)
                        keys += hits
                yield b.iloc[at].assign(key=np.array(keys, object))

        found.append(names.mapInPandas(search, schema))
    return reduce(DataFrame.union, found)


def match_targets(targets: DataFrame, assets: DataFrame) -> DataFrame:
    """(targets' columns, asset, outcome) for (pattern, kind or null) against assets (asset, kind).

    A pattern matches names that end with it; if none does, whatever the case; if that isn't exactly one, names that
    contain it. One match is accepted; none is "no match" ("bad type" if only other kinds match), more are "too many".

    Endings are joined as keys: every name is cut at the lengths that patterns have. The patterns that this leaves open are looked for in all
    names at once, by an automaton.
    """
    keys = targets.columns
    wanted = targets.distinct().withColumn("key", F.lower("pattern"))
    named = assets.withColumnRenamed("kind", "asset_kind")
    lengths = wanted.agg(F.collect_set(F.length("key")).alias("lengths"))  # one row; different lengths are few
    ends = named.withColumn("low", F.lower("asset")).join(F.broadcast(lengths)).select("asset", "asset_kind", "low", F.explode(F.filter("lengths", lambda n: n <= F.length("low"))).alias("n"))
    ends = ends.withColumn("key", F.substr("low", F.length("low") - F.col("n") + 1, F.col("n"))).drop("low", "n")
    fits = F.col("kind").isNull() | F.col("kind").eqNullSafe(F.col("asset_kind"))
    exact = F.endswith("asset", "pattern")
    one = lambda c, n: [F.count(F.when(fits & c, 1)).alias(f"n{n}"), F.min(F.when(fits & c, F.col("asset"))).alias(f"a{n}")]
    got = stored(wanted.join(ends, "key", "left").groupBy(*keys).agg(*one(exact, 1), *one(~exact, 2)))
    settled = F.when(F.col("n1") == 1, F.col("a1")).when((F.col("n1") == 0) & (F.col("n2") == 1), F.col("a2"))
    done = got.where(settled.isNotNull()).select(*keys, settled.alias("asset"), F.lit("matched").alias("outcome"))
    left = got.where(settled.isNull()).select(*keys)
    found = containing(named.withColumn("low", F.lower("asset")), "low", left.select(F.lower("pattern").alias("key")))
    some = left.withColumn("key", F.lower("pattern")).join(found, "key").groupBy(*keys).agg(*one(F.lit(True), 3), F.count("*").alias("any"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    held = left.alias("l").join(some.alias("s"), on, "left").select("l.*", F.coalesce("s.n3", F.lit(0)).alias("n3"), "s.a3", F.coalesce("s.any", F.lit(0)).alias("any"))
    asset = F.when(F.col("n3") == 1, F.col("a3"))
    outcome = F.when(asset.isNotNull(), "matched").when(F.col("n3") > 1, "too many").when(F.col("any") > 0, "bad type").otherwise("no match")
    return done.unionByName(held.select(*keys, asset.alias("asset"), outcome.alias("outcome")))
