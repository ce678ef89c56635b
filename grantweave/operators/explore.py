"""Lists, lookups, sorting and search over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NODE_ORDER
from ..storage import numbered


def summaries(nodes: DataFrame) -> DataFrame:
    """What lists show of a node; policies and default policies have no id there."""
    hidden = F.col("node_type").isin("policy", "default_policy")
    return nodes.select("node_type", F.when(~hidden, F.col("node_id")).alias("node_id"), "name", "connectors", F.when(F.col("node_type") == "asset", F.col("asset_type")).alias("asset_type"))


def listed(nodes: DataFrame, *types: str) -> DataFrame:
    """Nodes of the given types; without any, all but policies (default policies stay)."""
    return nodes.where(F.col("node_type").isin(*types) if types else F.col("node_type") != "policy")


def by_id(nodes: DataFrame, node_id: str, node_type: str | None = None) -> DataFrame:
    found = nodes.where(F.col("node_id") == node_id)
    return found.where(F.col("node_type") == node_type) if node_type else found


def by_name(nodes: DataFrame, name: str, node_type: str | None = None) -> DataFrame:
    found = nodes.where(F.col("name") == name)
    return found.where(F.col("node_type") == node_type) if node_type else found


def type_rank(node_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in NODE_ORDER]), node_type)


def sorted_nodes(nodes: DataFrame) -> DataFrame:
    """By type, then by name."""
    return nodes.orderBy(type_rank(F.col("node_type")), "name")


def placed(nodes: DataFrame) -> DataFrame:
    """All nodes with ``place``, counted from 1 by type, then by name."""
    return numbered(nodes, [type_rank(F.col("node_type")), F.col("name"), F.col("node_id")], "place")


def words_in(text: Column, term: str, case_sensitive: bool = False) -> Column:
    """Whether every word of the term (quoted ones with their blanks) is in the text."""
    import shlex

    words = [w for w in (shlex.split(term) if term.count('"') % 2 == 0 else term.split(" ")) if w]
    hay = text if case_sensitive else F.lower(text)
    found = F.lit(True)
    for w in words:
        found &= F.contains(hay, F.lit(w if case_sensitive else w.lower()))
    return found


def search(rows: DataFrame, text: str, term: str, limit: int | None = None, order: str | None = None, case_sensitive: bool = False) -> DataFrame:
    found = rows.where(words_in(F.col(text), term, case_sensitive))
    if order:
        found = found.orderBy(order)
    return found if limit is None else found.limit(limit)


def page(rows: DataFrame, number: int, size: int, order: str = "name") -> DataFrame:
    """One page of a list, counted from 0."""
    return rows.orderBy(order).offset(number * size).limit(size)


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").count()
