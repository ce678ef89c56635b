"""Paged and fanned-out answers of a server as a Spark data source, one request list per partition.

An answer is a list of pages of one resource: the users of a site, the grants to a role, the objects of a schema. The reader asks for
``pageNumber`` 1 first and learns from its pagination how many pages there are, ceil(totalAvailable / pageSize). At most ``parallel`` partitions
are made, and each sends its requests one after another, so no more than that many are under way however large the cluster
is; a lost executor repeats its own partition's requests. Few resources are cut by page, many by resource.

Conditions on ``resource`` choose what is asked for. Simple conditions on other columns (equality, membership, null) are checked in the reader,
so rows left out (deleted users, foreign grants) never reach Spark. What can't be checked there stays with Spark.

``SavedPages`` reads answers saved under ``resource=<name>/page=<number>/``; a live server is a subclass that overrides
``resources`` and ``fetch``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, Not
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import filesystem

#: Requests under way at once, entries of a batch.
PARALLEL, ROWS = 20, 1000


def page_count(total: int, size: int) -> int:
    return -(-total // size)


def at_place(answer: dict, place: str) -> list[dict]:
    for name in place.split("."):
        if name not in answer:
            raise ValueError(f"an answer has no list at {place}")
        answer = answer[name]
    return answer


def check(f) -> Callable[[dict], bool] | None:
    """A filter as a function of an entry; None if the reader can't check it."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, EqualTo) and len(inner.attribute) == 1:
            return lambda e, c=inner.attribute[0], v=inner.value: e.get(c) is not None and e[c] != v
        return None
    if len(getattr(f, "attribute", ())) != 1:
        return None
    c = f.attribute[0]
    if isinstance(f, EqualTo):
        return lambda e: e.get(c) is not None and e[c] == f.value
    if isinstance(f, EqualNullSafe):
        return lambda e: e.get(c) == f.value
    if isinstance(f, In):
        values = set(f.value)
        return lambda e: e.get(c) in values and e.get(c) is not None
    if isinstance(f, IsNull):
        return lambda e: e.get(c) is None
    if isinstance(f, IsNotNull):
        return lambda e: e.get(c) is not None
    return None


@dataclass
class Requests(InputPartition):
    """(resource, page); page 0: all pages of the resource, from the first on."""

    items: list[tuple[str, int]]


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType, fetch: Callable[[str, int], dict], resources: Callable[[], list[str]]):
        self.place, self.parallel = options["place"], int(options.get("parallel", PARALLEL))
        self.schema, self.fetch, self.resources = schema, fetch, resources
        self.filters: list = []
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("resource",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif isinstance(f, IsNotNull) and f.attribute == ("resource",):
                continue  # every request has one
            elif "resource" not in getattr(f, "attribute", ()) and check(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Requests]:
        names = sorted(r for r in self.resources() if self.wanted is None or r in self.wanted)
        items = [(r, 0) for r in names]
        if names and len(names) < self.parallel:  # few resources: their first pages tell how many others there are
            items = [(r, n) for r in names for n in range(1, self.pages(self.fetch(r, 1)) + 1)]
        slots = [items[i :: self.parallel] for i in range(min(self.parallel, len(items)))]
        return [Requests(s) for s in slots] or [Requests([])]

    def pages(self, answer: dict) -> int:
        info = answer.get("pagination")
        return max(1, page_count(int(info["totalAvailable"]), int(info["pageSize"]))) if info else 1

    def entries(self, items: list[tuple[str, int]]) -> Iterator[dict]:
        for resource, page in items:
            answer = self.fetch(resource, page or 1)
            last = self.pages(answer) if not page else page
            for n in range(page or 1, last + 1):
                answer = answer if n == (page or 1) else self.fetch(resource, n)
                info = answer.get("pagination")
                if not info or int(info["totalAvailable"]):
                    yield from ({"resource": resource, "page": n} | e for e in at_place(answer, self.place))

    def read(self, partition: Requests) -> Iterator[pa.RecordBatch]:
        checks = [check(f) for f in self.filters]
        arrow, rows = to_arrow_schema(self.schema), []
        for e in self.entries(partition.items):
            if all(c(e) for c in checks):
                rows.append({c: e.get(c) for c in arrow.names})
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class SavedPages(DataSource):
    """Answers saved as JSON under ``path``; ``place``: the dotted place of the list in an answer."""

    @classmethod
    def name(cls) -> str:
        return "answer_pages"

    def schema(self) -> str:
        return "resource string, page int, id string"

    def resources(self) -> list[str]:
        system, at, listing = filesystem(self.options["path"])
        return [unquote(os.path.basename(p).removeprefix("resource=")) for p in listing(at) if os.path.basename(p).startswith("resource=")]

    def fetch(self, resource: str, page: int) -> dict:
        system, at, listing = filesystem(f"{self.options['path']}/resource={quote(resource, safe=' ')}/page={page}")
        parts = []
        for p in listing(at):
            if not os.path.basename(p).startswith(("_", ".")):
                with system.open_input_stream(p) as f:
                    parts.append(f.read())
        if not parts:
            raise ValueError(f"page {page} of {resource} is missing")
        return json.loads(b"".join(parts))

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema, self.fetch, self.resources)


def answers(spark: SparkSession, path: str, place: str, schema: str, parallel: int = PARALLEL, source: type[DataSource] = SavedPages) -> DataFrame:
    """(resource, page, fields...): all entries of all pages."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).schema(f"resource string, page int, {schema}").option("place", place).option("parallel", parallel).load(path)


def latest(entries: DataFrame, key: str = "id") -> DataFrame:
    """One row per resource and id: while pages are read, entries can move to a later one."""
    rest = [c for c in entries.columns if c not in ("resource", key)]
    return entries.groupBy("resource", key).agg(F.max_by(F.struct(*rest), "page").alias("x")).select("resource", key, "x.*")
