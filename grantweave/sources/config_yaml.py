"""Configuration files: assets with policies, groups, users and tags, read in parallel from YAML."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USERS = "array<struct<name:string, identifiers:map<string,string>, groups:array<string>>>"
GROUPS = "array<struct<name:string, identifiers:map<string,string>, `member of`:array<string>>>"
POLICY = "users:array<string>, groups:array<string>, privileges:array<string>, metadata:map<string,string>"
ASSETS = f"""array<struct<id:string, connector:string, name:string, type:string, policies:array<struct<{POLICY}>>,
  `default policies`:array<struct<path:string, `target type`:string, `connector-managed`:boolean, {POLICY}>>>>"""
TAGS = """map<string, struct<description:string, value:string, pass_through_lineage:boolean, pass_through_hierarchy:boolean,
  apply_to:array<string>, remove_from:array<string>>>"""


PARSED = "json string, problems array<struct<line:int, column:int, message:string, context:string>>"
FILES = "*.y*ml"


def parse(text: str | None, many: bool, required: list[str]) -> tuple[str | None, list[dict]]:
    """A document's entries as JSON, without broken ones, and what is wrong: place (lines and columns count from 1), message and the line itself."""
    import yaml

    if text is None:
        return None, []
    lines, problems = text.splitlines(), []

    def problem(mark, message: str) -> None:
        problems.append({"line": mark.line + 1, "column": mark.column + 1, "message": message, "context": lines[mark.line] if mark.line < len(lines) else ""})

    make, out, failed = yaml.SafeLoader(""), [], None
    value = lambda node: make.construct_object(node, deep=True)
    try:
        for key, node in entries_of(text, many):
            if not isinstance(node, yaml.MappingNode):
                problem(node.start_mark, "expected a mapping")
                if node is key:  # of the whole document
                    out = None
                continue
            make.constructed_objects.clear()  # else it holds all nodes
            try:
                missing = [name for name in required if name not in {k.value for k, _ in node.value}]
                for name in missing:
                    problem(node.start_mark, f"{name} is missing")
                made = (None if key is None else value(key), value(node))
            except yaml.MarkedYAMLError as e:
                problem(e.problem_mark, e.problem)
                continue
            except Exception as e:  # raised once the rest is known to be YAML
                failed = failed or e
                continue
            if not missing:
                out.append(json.dumps(made[1]) if many else made)
    except yaml.MarkedYAMLError as e:
        problems.clear()
        problem(e.problem_mark or e.context_mark, " ".join(filter(None, (e.context, e.problem))))
        return None, problems
    except yaml.YAMLError as e:  # characters that no document may hold
        return None, [{"line": None, "column": None, "message": str(e).splitlines()[0], "context": ""}]
    if failed:
        raise failed
    if out is None:
        return None, problems
    return f"[{', '.join(out)}]" if many else json.dumps(dict(out)), problems


def entries_of(text: str, many: bool):
    """(key or null, node): a document's entries. Of a list, one node at a time is held; a document that is no mapping where one is expected is its own key."""
    import yaml

    loader = yaml.SafeLoader(text)
    try:
        loader.get_event()
        if loader.check_event(yaml.StreamEndEvent):
            return
        loader.get_event()
        first = loader.peek_event()
        if many and isinstance(first, yaml.SequenceStartEvent) and first.anchor is None:
            loader.get_event()
            while not loader.check_event(yaml.SequenceEndEvent):
                yield None, loader.compose_node(None, None)
            loader.get_event()
            rest = []
        else:
            root = loader.compose_node(None, None)
            if many:
                rest = [(None, node) for node in (root.value if isinstance(root, yaml.SequenceNode) else [root])]
            else:
                rest = root.value if isinstance(root, yaml.MappingNode) else [(root, root)]
        loader.get_event()
        if not loader.check_event(yaml.StreamEndEvent):
            raise yaml.composer.ComposerError("expected a single document in the stream", first.start_mark, "but found another document", loader.get_event().start_mark)
        yield from rest
    finally:
        loader.dispose()


def parsed(spark: SparkSession, path: str, many: bool, files: str, required: tuple[str, ...]) -> DataFrame:
    """(file, json, problems): a row per file."""

    @F.pandas_udf(PARSED)
    def parser(texts: pd.Series) -> pd.DataFrame:
        found = [parse(t, many, list(required)) for t in texts]
        return pd.DataFrame({"json": np.array([j for j, _ in found], object), "problems": [p for _, p in found]})

    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path, wholetext=True)
    # not input_file_name(): beside a Python function it can name the file of a later row
    return raw.select(F.col("_metadata.file_path").alias("file"), parser("value").alias("p")).select("file", "p.*")


def read(spark: SparkSession, path: str, schema: str, many: bool = True, files: str = FILES, required: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """(file, entry...): a row per entry of each file; a file with one mapping counts as a list of one. ``strict``: anything wrong is an error that
    tells its place; else broken files and entries are left out, and ``problems`` lists them."""
    docs = parsed(spark, path, many, files, required)
    first = F.get("problems", F.lit(0))
    text = F.concat("file", F.lit(":"), F.coalesce(first["line"], F.lit(0)), F.lit(":"), F.coalesce(first["column"], F.lit(0)), F.lit(": "), first["message"])
    value = F.when(F.size("problems") > 0, F.raise_error(text).cast("string")).otherwise(F.col("json")) if strict else F.col("json")
    entries = docs.select("file", F.from_json(value, schema, {"mode": "FAILFAST"}).alias("x"))
    return entries.select("file", F.explode("x")) if not many else entries.select("file", F.explode("x").alias("x")).select("file", "x.*")


def problems(spark: SparkSession, path: str, many: bool = True, files: str = FILES, required: tuple[str, ...] = ()) -> DataFrame:
    """(file, line, column, message, context): what is wrong with configuration files; the other files can still be read."""
    return parsed(spark, path, many, files, required).select("file", F.explode("problems").alias("p")).select("file", "p.*")


def users(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    return read(spark, path, USERS, files=files)


def groups(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    return read(spark, path, GROUPS, files=files).withColumnRenamed("member of", "member_of")


def assets(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    return read(spark, path, ASSETS, files=files).withColumnRenamed("default policies", "default_policies")


def tags(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    return read(spark, path, TAGS, many=False, files=files).select("file", F.col("key").alias("tag"), "value.*")


def policies(assets: DataFrame) -> DataFrame:
    """(file, asset, agent_type, agent, privileges, seq) of explicit policies."""
    p = assets.select("file", F.col("id").alias("asset"), F.posexplode("policies").alias("seq", "p"))
    one = lambda kind: p.select("file", "asset", F.lit(kind).alias("agent_type"), F.explode(f"p.{kind}s").alias("agent"), F.coalesce("p.privileges", F.array().cast("array<string>")).alias("privileges"), "p.metadata", "seq")
    return one("user").unionByName(one("group"))


def default_policies(assets: DataFrame) -> DataFrame:
    p = assets.select("file", F.col("id").alias("root"), F.explode("default_policies").alias("p"))
    one = lambda kind: p.select("file", "root", "p.path", F.col("p.target type").alias("target_type"), F.lit(kind).alias("agent_type"), F.explode(f"p.{kind}s").alias("agent"), "p.privileges", "p.metadata", F.coalesce("p.connector-managed", F.lit(False)).alias("connector_managed"))
    return one("user").unionByName(one("group"))


def tag_targets(tags: DataFrame, column: str = "apply_to") -> DataFrame:
    """(tag, pattern, kind) of a tag's targets, each a name, or a mapping {name, type} whose type the asset must have."""
    x = tags.select("tag", F.explode(column).alias("target"))
    typed = F.from_json("target", "name string, type string", {"mode": "PERMISSIVE"})
    plain = ~F.startswith("target", F.lit("{"))
    return x.select("tag", F.when(plain, F.col("target")).otherwise(typed["name"]).alias("pattern"), F.when(~plain, typed["type"]).alias("kind"))
