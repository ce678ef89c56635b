"""Statements for the warehouse, as rows (stage, seq, statement); stages run one after another, 0 first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..storage import numbered


def name(c: str) -> Column:
    return quoted(F.col(c))


def each(df: DataFrame, condition: Column, stage: int, text: Column, over: str | None = None) -> DataFrame:
    """One statement per row, or per element ``x`` of an array column."""
    rows = df.where(condition)
    rows = rows.withColumn("x", F.explode(over)) if over else rows
    return rows.select(F.lit(stage).alias("stage"), text.alias("statement"))


def groups(diffs: DataFrame, owner_role: str) -> DataFrame:
    """From a group diff (name, change, to_add, to_remove)."""
    is_ = lambda c: F.col("change") == c
    role = name("name")
    return reduce(
        DataFrame.union,
        [
            each(diffs, is_("remove"), 0, F.concat(F.lit("GRANT OWNERSHIP ON ROLE "), role, F.lit(" TO "), quoted(F.lit(owner_role)), F.lit(";"))),
            each(diffs, is_("add"), 1, F.concat(F.lit("CREATE ROLE "), role, F.lit(";"))),
            each(diffs, is_("remove"), 1, F.concat(F.lit("DROP ROLE "), role, F.lit(";"))),
            each(diffs, ~is_("remove"), 2, F.concat(F.lit("GRANT ROLE "), name("x"), F.lit(" TO ROLE "), role, F.lit(";")), "to_add"),
            each(diffs, is_("modify"), 2, F.concat(F.lit("REVOKE ROLE "), name("x"), F.lit(" FROM ROLE "), role, F.lit(";")), "to_remove"),
        ],
    )


def memberships(diffs: DataFrame) -> DataFrame:
    """From a membership diff (user_name, to_add, to_remove)."""
    user = name("user_name")
    give = each(diffs, F.lit(True), 2, F.concat(F.lit("GRANT ROLE "), name("x"), F.lit(" TO USER "), user, F.lit(";")), "to_add")
    return give.union(each(diffs, F.lit(True), 2, F.concat(F.lit("REVOKE ROLE "), name("x"), F.lit(" FROM USER "), user, F.lit(";")), "to_remove"))


def grants(diffs: DataFrame, target: Column) -> DataFrame:
    """GRANT and REVOKE for a policy diff (agent_type, agent, change, to_add, to_remove) on ``target``.

    Ownership is granted by itself; a statement with nothing left to grant or revoke isn't made.
    """
    to = F.concat(F.when(F.col("agent_type") == "user", F.lit("USER ")).otherwise("ROLE "), name("agent"))
    plain = F.filter("to_add", lambda p: p != "OWNERSHIP")
    own = F.array_contains("to_add", F.lit("OWNERSHIP"))
    gone, modified = F.col("change") == "remove", F.col("change") == "modify"
    return reduce(
        DataFrame.union,
        [
            each(diffs, own & ~gone, 2, F.concat(F.lit("GRANT OWNERSHIP ON "), target, F.lit(" TO "), to, F.lit(" COPY CURRENT GRANTS;"))),
            each(diffs, (F.size(plain) > 0) & ~gone, 2, F.concat(F.lit("GRANT "), F.array_join(plain, ", "), F.lit(" ON "), target, F.lit(" TO "), to, F.lit(";"))),
            each(diffs, gone, 2, F.concat(F.lit("REVOKE ALL ON "), target, F.lit(" FROM "), to, F.lit(";"))),
            each(diffs, modified & (F.size("to_remove") > 0), 2, F.concat(F.lit("REVOKE "), F.array_join("to_remove", ", "), F.lit(" ON "), target, F.lit(" FROM "), to, F.lit(";"))),
        ],
    )


def policies(diffs: DataFrame) -> DataFrame:
    """Diff rows also carry asset_kind and asset (a quoted, dotted name)."""
    return grants(diffs, F.concat_ws(" ", "asset_kind", "asset"))


def default_policies(diffs: DataFrame) -> DataFrame:
    """Diff rows also carry root_kind, root (a quoted, dotted name) and target_type."""
    return grants(diffs, F.concat(F.lit("FUTURE "), F.col("target_type"), F.lit("S IN "), F.col("root_kind"), F.lit(" "), F.col("root")))


def ordered(*statements: DataFrame) -> DataFrame:
    """All statements with a place within their stage. A plan is read in order, stage by stage."""
    every = reduce(DataFrame.union, statements)
    return numbered(every, [F.col("statement")], "seq", "stage").select("stage", "seq", "statement")
