import uuid

import pytest
from pyspark.sql import functions as F

from grantweave.functions import cual, names, paths


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("path", "depth", "endless"), [("**", 1, True), ("/*", 1, False), ("*/**", 2, True), ("*/*", 2, False), ("*/*/*/*/*", 5, False)])
def test_wildcards(spark, path, depth, endless):
    d, e = paths.wildcard(F.lit(path))
    assert (value(spark, d), value(spark, e)) == (depth, endless)


def test_priorities_sort_as_documented(spark):
    score = lambda d, p: value(spark, paths.priority(F.lit(d), F.lit(p)))
    found = [score(2, "/*/**"), score(2, "/*"), score(2, "/**"), score(1, "/*/*")]
    assert found == sorted(found, reverse=True) and found[1:3] == ["0022", "0021"]


@pytest.mark.parametrize("name", ["snowflake::a/b (TABLE)", "é ⇨ x", "", "user"])
def test_uuid5(spark, name):
    assert value(spark, names.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_cual_keeps_plus_signs(spark):
    c = F.lit("snowflake://acc.x/db%20one/a+b/?type=table")
    assert value(spark, cual.path(c)) == ["db one", "a+b"]
    assert value(spark, cual.prefix(c)) == "snowflake://acc.x"
    assert value(spark, cual.asset_type(c)) == "table" and value(spark, cual.scheme(c)) == "snowflake"
    built = cual.build(F.lit("dw://h"), F.array(F.lit("a b+*~"), F.lit("c/d")), F.lit(None).cast("string"))
    assert value(spark, built) == "dw://h/a%20b%2B%2A~/c%2Fd"
    assert value(spark, cual.path(built)) == ["a b+*~", "c/d"]
    assert value(spark, cual.warehouse(F.lit("account"), F.lit("DB"), F.lit(None).cast("string"))) == "snowflake://account.snowflakecomputing.com/DB"


def test_names(spark):
    assert value(spark, names.asset_name(F.lit("c"), F.array(F.lit("a"), F.lit("b")), F.lit("T"))) == "c::a/b (T)"
    assert value(spark, names.default_policy_name(*map(F.lit, ("g", "r", "/*", "t")))) == "g -> r//* (t)"
    assert value(spark, names.table_parts(F.lit('bob."""Special Name"""'))) == ["BOB", '""Special Name""']
    assert value(spark, names.table_parts(F.lit("[GOLD].[IRIS_JOINED_TABLE]"))) == ["GOLD", "IRIS_JOINED_TABLE"]
    assert value(spark, names.quoted(F.lit("RAW"), F.lit('"Special Name"'))) == '"RAW"."""Special Name"""'
    assert value(spark, names.identifier(F.lit('"a"'))) == "a" and value(spark, names.identifier(F.lit("a"))) == "A"
    assert value(spark, names.clean_file_name(F.lit("a/b c."))) == "a_b_c_"
    ids = value(spark, names.identifiers(F.lit("A"), F.lit(" "), F.lit("e@x.y")))
    assert [i.kind for i in ids] == ["first_name", "email"]
    assert value(spark, names.user_name(F.lit(None).cast("string"), F.lit(" "), F.lit("l"))) == "l"


def test_wrong_booleans_are_errors(spark):
    assert value(spark, names.to_boolean(F.lit("true"))) is True
    with pytest.raises(Exception, match="not a boolean"):
        value(spark, names.to_boolean(F.lit("yes")))


def test_ancestors(spark):
    assert value(spark, paths.ancestors(F.array(F.lit("a"), F.lit("b")))) == [["a"], ["a", "b"]]
    assert value(spark, paths.ancestors(F.array().cast("array<string>"))) == []
