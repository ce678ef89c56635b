"""All queries over the derived graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exchange, governance, graph
from .derived import Tables, oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = graph.QUERIES | governance.QUERIES | exchange.QUERIES
    return {name: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for name, f in every.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(text) for name, text in (graph.SQL | governance.SQL | exchange.SQL).items()}
