"""What a connector offers: its tables, what it can do, and plans for its changes."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from ..plans import bi_rest, warehouse_sql
from . import exports


class Connector(ABC):
    """Reads one platform's tables and plans changes to it; carrying plans out is left to the caller."""

    name: str

    @abstractmethod
    def check(self) -> bool:
        """Whether its exports can be read."""

    @abstractmethod
    def tables(self) -> dict[str, DataFrame]:
        """Its tables by name."""

    @abstractmethod
    def plan(self, diffs: dict[str, DataFrame]) -> DataFrame:
        """Ordered steps for differences by kind (groups, memberships, policies, default_policies)."""


class ExportedConnector(Connector):
    """A connector over tables saved as Parquet, one folder per table."""

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...]):
        self.spark, self.path, self.names = spark, path, names

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.path}/{n}") for n in self.names}

    def check(self) -> bool:
        return all(exports.cached(self.spark, f"{self.path}/{n}") is not None for n in self.names)


class Warehouse(ExportedConnector):
    name = "snowflake"

    def plan(self, diffs: dict[str, DataFrame]) -> DataFrame:
        made = {"groups": lambda d: warehouse_sql.groups(d, "ACCOUNTADMIN"), "memberships": warehouse_sql.memberships, "policies": warehouse_sql.policies, "default_policies": warehouse_sql.default_policies}
        return warehouse_sql.ordered(*[made[k](d) for k, d in diffs.items()])


class BiServer(ExportedConnector):
    name = "tableau"

    def plan(self, diffs: dict[str, DataFrame]) -> DataFrame:
        ids = self.tables()["group_ids"]
        made = {"groups": lambda d: bi_rest.groups(d, ids), "memberships": lambda d: bi_rest.memberships(d, ids), "policies": bi_rest.policies, "default_policies": bi_rest.default_policies}
        return bi_rest.ordered(*[made[k](d) for k, d in diffs.items()])
