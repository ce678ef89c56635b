"""Policy state: combination, default policies and their priority, folding, diffs, compaction and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.paths import priority

AGENT = ["asset", "agent_type", "agent"]
DEFAULT = ["root", "path", "target_type", "agent_type", "agent"]
NO_TEXT = "array<string>"


def united(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


NO_METADATA = "map<string,string>"


def merged_metadata(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metadata: a map key by key, of unlike values the first (by ``seq``, then value)."""
    each = states.select(*keys, "seq", F.explode("metadata").alias("k", "v")).groupBy(*keys, "k").agg(F.min(F.struct("seq", "v")).alias("x"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("x.v").alias("v"))))).alias("metadata"))


def combine(states: DataFrame, keys: list[str] = AGENT) -> DataFrame:
    """One row per key: privileges united, metadata merged key by key (where the table has ``metadata`` and ``seq``)."""
    found = states.groupBy(*keys).agg(united("privileges").alias("privileges"))
    if not {"metadata", "seq"} <= set(states.columns):
        return found
    return with_metadata(found, merged_metadata(states, keys), keys)


def with_metadata(found: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(metadata, keys, "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast(NO_METADATA)))


def metadata_conflicts(states: DataFrame, keys: list[str] = AGENT) -> DataFrame:
    """keys, key, kept, given up: metadata that ``combine`` can't keep, as another value came first."""
    each = states.select(*keys, "seq", F.explode("metadata").alias("key", "v")).groupBy(*keys, "key").agg(F.min(F.struct("seq", "v")).alias("x"), F.array_sort(F.collect_set("v")).alias("values"))
    return each.where(F.size("values") > 1).select(*keys, "key", F.col("x.v").alias("kept"), F.array_remove("values", F.col("x.v")).alias("given_up"))


def last_in_file(states: DataFrame) -> DataFrame:
    """Within a file the last row of an (asset, agent) counts; files are combined afterwards."""
    kept = ["privileges", "seq", *(["metadata"] if "metadata" in states.columns else [])]
    last = states.groupBy("file", *AGENT).agg(F.max_by(F.struct(*kept), "seq").alias("s"))
    return combine(last.select(*AGENT, *[f"s.{c}" for c in kept]))


def expand(explicit: DataFrame, defaults: DataFrame) -> DataFrame:
    """Policies that hold for each (asset, agent): the explicit one, else the default of the highest priority.

    ``defaults`` are already expanded to assets: AGENT, root_depth, path, privileges. Equal priorities are united.
    An explicit policy without privileges blocks defaults and stays, empty. Explicit policies keep their metadata (if the table has any); what a
    default policy expands to has none.
    """
    extra = ["metadata"] if "metadata" in explicit.columns else []
    levels = defaults.withColumn("level", priority(F.col("root_depth"), F.col("path"))).groupBy(*AGENT, "level").agg(united("privileges").alias("privileges"))
    every = explicit.select(*AGENT, "privileges", *extra, F.lit(None).cast("string").alias("level"), F.lit(1).alias("explicit")).unionByName(
        levels.select(*AGENT, "privileges", *[F.create_map().cast(NO_METADATA).alias(c) for c in extra], "level", F.lit(0).alias("explicit"))
    )
    best = Window.partitionBy(*AGENT).orderBy(F.desc("explicit"), F.desc("level"))
    return every.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def compact(policies: DataFrame, expanded_defaults: DataFrame) -> DataFrame:
    """What must be written besides the defaults: policies unlike the winning default or with metadata of their own, and empty ones
    that block it.

    Expanding the result over the same defaults gives the policies back, metadata included.
    """
    extra = ["metadata"] if "metadata" in policies.columns else []
    winning = expand(policies.limit(0), expanded_defaults).select(*AGENT, F.col("privileges").alias("given"))
    x = policies.select(*AGENT, "privileges", *extra).join(winning, AGENT, "full_outer")
    unlike = F.col("given").isNull() | F.col("privileges").isNull() | (F.col("privileges") != F.col("given"))
    for c in extra:
        unlike |= F.size(entries(c)) > 0
    return x.where(unlike).select(*AGENT, F.coalesce("privileges", F.array().cast(NO_TEXT)).alias("privileges"), *[F.coalesce(c, F.create_map().cast(NO_METADATA)).alias(c) for c in extra])


def fold(policies: DataFrame, keys: list[str]) -> DataFrame:
    """Agents with equal privileges (and metadata, if the table has any) on a key share a row: keys, privileges, users, groups."""
    agents = lambda kind: F.array_sort(F.collect_set(F.when(F.col("agent_type") == kind, F.col("agent"))))
    same = [F.array_sort("privileges").alias("privileges")]
    known = "metadata" in policies.columns
    folded = policies.groupBy(*keys, *same, *([entries("metadata").alias("metadata")] if known else [])).agg(agents("user").alias("users"), agents("group").alias("groups"))
    return folded.withColumn("metadata", F.map_from_entries("metadata")) if known else folded


def non_default_policies(covered: DataFrame, policies: DataFrame) -> DataFrame:
    """Empty policies "asset-grantee" where a default policy covers (asset, agent) but no policy says so."""
    missing = covered.select("asset", "agent").distinct().join(policies.select("asset", "agent").distinct(), ["asset", "agent"], "left_anti")
    return missing.select(F.concat_ws("-", "asset", "agent").alias("name"), "asset", "agent", F.array().cast(NO_TEXT).alias("privileges"))


# Differences between desired and observed state


def set_difference(wanted: str, have: str) -> tuple[Column, Column]:
    """(to add, to remove)."""
    w, h = (F.coalesce(c, F.array().cast(NO_TEXT)) for c in (wanted, have))
    return F.array_sort(F.array_except(w, h)), F.array_sort(F.array_except(h, w))


def no_entries() -> Column:
    return F.array().cast("array<struct<key:string,value:string>>")


def entries(metadata: str) -> Column:
    """A map's entries, sorted; none for null."""
    return F.array_sort(F.coalesce(F.map_entries(metadata), no_entries()))


def diff(wanted: DataFrame, have: DataFrame, keys: list[str], value: str, flag: str | None = None) -> DataFrame:
    """Full-outer difference by key: change (add, remove, modify), to_add, to_remove; equal rows are left out.

    Where a side has a map ``metadata``, its entries are compared like privileges and reported as add_metadata and remove_metadata; a side without the
    column has none.
    ``flag``: a boolean column whose change alone is a modification, reported as (flag): true, false or null if unchanged.
    """
    extra, known = [flag] if flag else [], "metadata" in wanted.columns or "metadata" in have.columns
    side = lambda df, s: df.select(*keys, F.col(value).alias(s), *[F.col(c).alias(f"{s}f") for c in extra], *([(entries("metadata") if "metadata" in df.columns else no_entries()).alias(f"{s}m")] if known else []), F.lit(1).alias(f"in_{s}"))
    add, remove = set_difference("w", "h")
    x = side(wanted, "w").join(side(have, "h"), keys, "full_outer").withColumn("to_add", add).withColumn("to_remove", remove)
    change = F.when(F.col("in_h").isNull(), "add").when(F.col("in_w").isNull(), "remove").otherwise("modify")
    same = (F.size("to_add") == 0) & (F.size("to_remove") == 0)
    if flag:
        same &= F.col("wf").eqNullSafe(F.col("hf"))
        x = x.withColumn(flag, F.when(~F.col("wf").eqNullSafe(F.col("hf")), F.coalesce("wf", F.lit(False))))
    if known:
        none = no_entries()
        less = lambda a, b: F.array_except(F.coalesce(a, none), F.coalesce(b, none))
        x = x.withColumns({"add_metadata": less("wm", "hm"), "remove_metadata": less("hm", "wm")})
        same &= (F.size("add_metadata") == 0) & (F.size("remove_metadata") == 0)
        extra = ["add_metadata", "remove_metadata", *extra]
    x = x.withColumn("change", change).where((F.col("change") != "modify") | ~same)
    x = x.withColumns({c: F.map_from_entries(c) for c in extra if c != flag})
    return x.select(*keys, "change", "to_add", "to_remove", *extra)


def policy_diff(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """By (asset, agent). A wanted policy without privileges and metadata is nothing to add; what is there is removed then, too."""

    def some(df: DataFrame) -> DataFrame:
        return df.where((F.size("privileges") > 0) | (F.size(entries("metadata")) > 0) if "metadata" in df.columns else F.size("privileges") > 0)

    return diff(some(wanted), some(have), AGENT, "privileges")


def default_policy_diff(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return diff(wanted, have, DEFAULT, "privileges", "connector_managed")


def in_order(diffs: DataFrame, column: str, fold_case: bool = False) -> DataFrame:
    """Differences in the order in which they are shown: by asset, or groups by name whatever the case."""
    return diffs.orderBy(F.lower(column) if fold_case else F.col(column), column)


def lasting_defaults(defaults: DataFrame) -> DataFrame:
    """Default policies that their connector keeps; the others only stand for the policies they expand to, and go after that."""
    return defaults.where("connector_managed")


def group_diff(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(name, member_of); a removed group needs no membership detail."""
    return diff(wanted, have, ["name"], "member_of").withColumn("to_remove", F.when(F.col("change") == "remove", F.array().cast(NO_TEXT)).otherwise(F.col("to_remove")))


def identity_diff(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(user_name, connector, local_name) rows: identities as "connector=local" sets per user."""
    state = lambda df: df.groupBy("user_name").agg(F.array_sort(F.collect_set(F.concat_ws("=", "connector", "local_name"))).alias("ids"))
    return diff(state(wanted), state(have), ["user_name"], "ids")


def membership_diff(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(user_name, groups): users on both sides whose groups differ."""
    add, remove = set_difference("w", "h")
    x = wanted.select("user_name", F.col("groups").alias("w")).join(have.select("user_name", F.col("groups").alias("h")), "user_name")
    return x.select("user_name", add.alias("to_add"), remove.alias("to_remove")).where((F.size("to_add") > 0) | (F.size("to_remove") > 0))


def user_diff(identity: DataFrame, membership: DataFrame) -> DataFrame:
    """Identity and membership changes as one row per user."""
    m = membership.select("user_name", F.col("to_add").alias("add_groups"), F.col("to_remove").alias("remove_groups"))
    return identity.withColumnsRenamed({"to_add": "add_ids", "to_remove": "remove_ids"}).join(m, "user_name", "full_outer")


def two_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side alone, "left" or "right"."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def by_connector(diffs: DataFrame, column: str) -> DataFrame:
    """Differences with the connector that must carry them out, from a "connector::name" column."""
    return diffs.withColumn("connector", F.substring_index(column, "::", 1))


def users_by_connector(membership: DataFrame, group_names: DataFrame) -> DataFrame:
    """(connector, user_name, to_add, to_remove): a membership difference dealt out to the connectors that its groups belong to;
    ``group_names``: (group, connector, local)."""
    one = lambda c: membership.select("user_name", F.explode(c).alias("group")).join(group_names, "group").select("connector", "user_name", "local", F.lit(c).alias("side"))
    set_of = lambda c: F.array_sort(F.collect_set(F.when(F.col("side") == c, F.col("local")))).alias(c)
    return one("to_add").union(one("to_remove")).groupBy("connector", "user_name").agg(set_of("to_add"), set_of("to_remove"))


def group_names(groups: DataFrame, connectors: DataFrame, overrides: DataFrame) -> DataFrame:
    """(group, connector, local): a prefixed group has one connector; others all that can write groups, by their own names."""
    pinned = groups.where(F.contains("group", F.lit("::"))).select("group", F.substring_index("group", "::", 1).alias("connector"), F.expr("substring(group, locate('::', group) + 2)").alias("local"))
    free = groups.where(~F.contains("group", F.lit("::"))).join(F.broadcast(connectors.select("connector")))  # a handful of connectors
    free = free.join(overrides, ["group", "connector"], "left").select("group", "connector", F.coalesce("local", "group").alias("local"))
    return pinned.unionByName(free)


# Validation


def violations(*found: tuple[str, DataFrame, str, str]) -> DataFrame:
    """(rule, subject, message) from (rule, rows, subject column, message)."""
    return reduce(DataFrame.union, [df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"), F.lit(text).alias("message")) for rule, df, c, text in found])


def unknown(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct values of a column that aren't among the known keys; nulls aren't checked."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(F.col(key).alias(column)), column, "left_anti")


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).count().where("count > 1")


def inconsistent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys under which a value that must be the same for all isn't."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("values")).where("values > 1")


# Renames and removals across configurations


def rename_agent(policies: DataFrame, kind: str, old: str, new: str) -> DataFrame:
    """Folded policies (users, groups) with one agent renamed."""
    return policies.withColumn(kind, F.array_sort(F.array_distinct(F.transform(kind, lambda a: F.when(a == old, new).otherwise(a)))))


def remove_agent(policies: DataFrame, kind: str, name: str) -> DataFrame:
    """Folded policies without one agent; a policy that nobody is left in goes."""
    return policies.withColumn(kind, F.array_remove(kind, name)).where((F.size("users") > 0) | (F.size("groups") > 0))
