"""Transformation-tool manifests: models, sources and their dependencies as lineage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cual as C
from ..operators.traverse import contract_marked
from ..storage import stored

SCHEMA = """nodes map<string, struct<unique_id:string, relation_name:string, resource_type:string,
  config:struct<enabled:boolean, materialized:string>, fqn:array<string>, database:string, schema:string, description:string, tags:array<string>>>,
  sources map<string, struct<relation_name:string>>, child_map map<string, array<string>>"""
#: Resource types with a relation of their own, and name starts that aren't lineage.
KINDS = ("model", "snapshot", "seed")
SKIPPED = ("test", "analysis", "exposure")


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row per manifest: each a file as the tool writes it, or (``lines``) a line of files that hold many."""
    return spark.read.schema(SCHEMA).json(path, multiLine=not lines)


def models(manifest: DataFrame) -> DataFrame:
    """(unique_id, relation, ephemeral, enabled): nodes that become relations; ephemeral ones only pass lineage on."""
    n = manifest.select(F.explode(F.map_values("nodes")).alias("n")).select("n.*").where(F.col("resource_type").isin(*KINDS))
    ephemeral = F.coalesce(F.col("config.materialized") == "ephemeral", F.lit(False))
    built = F.concat_ws(".", "database", "schema", F.element_at("fqn", -1))
    relation = F.when(ephemeral, F.col("unique_id")).otherwise(F.coalesce(F.replace("relation_name", F.lit('"'), F.lit("")), built))
    return n.select("unique_id", relation.alias("relation"), ephemeral.alias("ephemeral"), F.col("config.enabled").alias("enabled"), "description", "tags")


def sources(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("sources").alias("unique_id", "s")).select("unique_id", F.replace("s.relation_name", F.lit('"'), F.lit("")).alias("relation"))


def named(manifest: DataFrame) -> DataFrame:
    """(unique_id, relation, inner): models and sources; inner: whether an ephemeral model goes by that relation."""
    own = models(manifest).select("unique_id", "relation", "ephemeral")
    names = stored(own.union(sources(manifest).select("unique_id", "relation", F.lit(False))))
    inner = names.where("ephemeral").select("relation", F.lit(True).alias("inner")).distinct()
    return names.select("unique_id", "relation").join(inner, "relation", "left").select("unique_id", "relation", F.coalesce("inner", F.lit(False)).alias("inner"))


def derivations(manifest: DataFrame, shown: Callable[[Column], Column]) -> DataFrame:
    """(src, dst) between relations, ephemeral models contracted; ``dst`` as ``shown``, which is worked out once a name instead of once a pair."""
    starts = lambda c: reduce(Column.__or__, [F.startswith(c, F.lit(prefix)) for prefix in SKIPPED])
    names = named(manifest)
    names = stored(names.withColumn("dst", F.when(F.col("inner"), F.col("relation")).otherwise(shown(F.col("relation")))))
    # parents get their relation before their children are spread
    parents = manifest.select(F.explode("child_map").alias("p", "cs")).where(~starts("p"))
    parents = parents.join(names.select(F.col("unique_id").alias("p"), F.col("relation").alias("src"), F.col("inner").alias("leaves_inner")), "p")
    pairs = parents.select("src", "leaves_inner", F.explode("cs").alias("c")).where(~starts("c"))
    return contract_marked(pairs.join(names.select(F.col("unique_id").alias("c"), "dst", F.col("inner").alias("meets_inner")), "c"))


def lineage(manifest: DataFrame) -> DataFrame:
    """(src, dst) between relations, ephemeral models contracted."""
    return derivations(stored(manifest), lambda c: c)


def references(manifest: DataFrame, account: str) -> DataFrame:
    """(cual, enabled, description, tags, derived_to): asset references with what derives from them; sources carry no metadata."""
    cual = lambda c: C.relation(F.lit(account), F.col(c) if isinstance(c, str) else c)
    manifest = stored(manifest)  # files are parsed once
    to = derivations(manifest, cual).groupBy(F.col("src").alias("relation")).agg(F.array_sort(F.collect_set("dst")).alias("derived_to"))
    own = models(manifest).where("NOT ephemeral").select("relation", "enabled", "description", "tags").unionByName(sources(manifest).select("relation"), allowMissingColumns=True)
    return own.join(to, "relation", "left").select(cual("relation").alias("cual"), "enabled", "description", "tags", F.coalesce("derived_to", F.array().cast("array<string>")).alias("derived_to"))
