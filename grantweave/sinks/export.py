"""Snapshots, CSV, JSON, drawings and configuration documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def csv(df: DataFrame, path: str) -> None:
    """Every value quoted, lines ending with carriage return and line feed."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").csv(path)


def json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, as an API would serve them."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a drawing in the DOT language: (line_no, line); write them as text in that order."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = edges.select(F.lit(1).alias("line_no"), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("line"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph {"), (2, "}")], "line_no int, line string")
    return lines.union(ends).orderBy("line_no", "line")


def documents(df: DataFrame, key: str) -> DataFrame:
    """(key, document): rows as documents of their own, for files named by key."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("document"))


def file_paths(chain: DataFrame, connector: str) -> DataFrame:
    """(node, file) from ancestor chains, the nearest first: a folder per ancestor, from the root down."""
    from ..functions.names import clean_file_name

    parts = F.transform(F.concat(F.reverse("chain"), F.array("node")), clean_file_name)
    return chain.select("node", F.concat(F.lit(connector), F.lit("/"), F.array_join(parts, "/"), F.lit(".yaml")).alias("file"))


def editor_schema(users: DataFrame, groups: DataFrame, privileges: DataFrame) -> DataFrame:
    """One JSON document of the names that an editor may suggest, sorted; the sets are configuration."""
    one = lambda df, c: df.agg(F.array_sort(F.collect_set(c)).alias(c))
    return one(users, "user").join(one(groups, "group")).join(one(privileges, "privilege")).select(F.to_json(F.struct("user", "group", "privilege")).alias("schema"))
