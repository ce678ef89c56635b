"""Paths: ancestors, wildcards, priorities, and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = " ⇨ "


def ancestors(path: Column) -> Column:
    """All prefixes, shortest first, the path itself included."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, 1, i))).otherwise(F.array().cast("array<array<string>>"))


def wildcard(path: Column) -> tuple[Column, Column]:
    """(depth, open-ended) of a wildcard path, one slash at either end being optional."""
    bare = F.regexp_replace(path, "^/|/$", "")
    parts = F.split(bare, "/")
    return F.size(parts), F.element_at(parts, -1) == "**"


def legal_wildcard(path: Column) -> Column:
    """Only * and ** are allowed, ** only at the end."""
    return path.rlike(r"^/?(\*/)*(\*|\*\*)/?$")


def priority(root_depth: Column, path: Column) -> Column:
    """Compared as text, larger wins: deeper roots first, then 2 for each * and 1 for **."""
    marks = F.regexp_replace(F.regexp_replace(path, r"\*\*", "1"), r"\*", "2")
    return F.concat(F.lpad(root_depth.cast("string"), 3, "0"), F.regexp_replace(marks, "/", ""))


def shown(path: Column, arrow: str = ARROW) -> Column:
    return F.array_join(path, arrow)


def prefixes(include: Column) -> Column:
    """An include entry and every dotted prefix above it."""
    parts = F.split(include, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def included(name: Column, pattern: Column) -> Column:
    """A trailing * matches any ending; otherwise names must be equal."""
    return F.when(pattern.endswith("*"), name.startswith(F.substr(pattern, F.lit(1), F.length(pattern) - 1))).otherwise(name == pattern)
