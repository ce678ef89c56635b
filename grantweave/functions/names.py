"""Display names of nodes, their ids, and quoted identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the published namespace for ids made from urls.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def group_name(origin: Column, name: Column) -> Column:
    return F.concat(origin, F.lit("::"), name)


def asset_name(connector: Column, path: Column, asset_type: Column) -> Column:
    """connector::a/b (TYPE); the type is left out when null."""
    base = F.concat(connector, F.lit("::"), F.array_join(path, "/"))
    return F.when(asset_type.isNull(), base).otherwise(F.concat(base, F.lit(" ("), asset_type, F.lit(")")))


def default_policy_name(grantee: Column, root: Column, path: Column, kind: Column) -> Column:
    return F.concat(grantee, F.lit(" -> "), root, F.lit("/"), path, F.lit(" ("), kind, F.lit(")"))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The version-5 id of a name, without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def split_group(name: Column) -> tuple[Column, Column]:
    """(connector or null, name) from "connector::name", cut at the first mark."""
    at = F.locate("::", name)
    return F.when(at > 0, F.substr(name, F.lit(1), at - 1)), F.when(at > 0, F.substr(name, at + 2)).otherwise(name)


def identifier(name: Column) -> Column:
    """A warehouse identifier as stored: quoted ones lose their quotes, others become upper case."""
    quoted = name.startswith('"') & name.endswith('"') & (F.length(name) >= 2)
    return F.when(quoted, F.substr(name, F.lit(2), F.length(name) - 2)).otherwise(F.upper(name))


def quoted(*parts: Column) -> Column:
    """A dotted name with every part quoted and inner quotes doubled; null parts are left out."""
    each = lambda p: F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.array_compact(F.array(*[each(p) for p in parts])), ".")


def model_parts(name: Column) -> Column:
    """Parts of a dotted relation name: upper case unless a part is written with escaped quotes."""
    return F.transform(F.split(name, r"\."), lambda p: F.when(p.startswith('\\"'), F.replace(p, F.lit('\\"'), F.lit(""))).otherwise(F.upper(p)))


def table_parts(name: Column) -> Column:
    """Parts of a table name as a BI tool writes it: [A].[B], or dotted with optional quotes; unquoted parts become upper case.
    Quotes inside a part stay as they are written in quotes, doubled."""
    bracketed = F.transform(F.regexp_extract_all(name, F.lit(r"\[([^\]]*)\]"), 1), lambda p: F.replace(p, F.lit('"'), F.lit('""')))
    dotted = F.regexp_extract_all(name, F.lit(r'"((?:[^"]|"")*)"|([^."]+)'), 0)
    plain = F.transform(dotted, lambda p: F.when(p.startswith('"'), F.substr(p, F.lit(2), F.length(p) - 2)).otherwise(F.upper(p)))
    return F.when(name.startswith("["), bracketed).otherwise(plain)


def clean_file_name(name: Column) -> Column:
    """A name without characters that file systems refuse."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\?%*:|\"<>,;=\s]", "_"), r"\.$", "_")


def identifiers(first: Column, last: Column, email: Column, **others: Column) -> Column:
    """Known identifiers of a user; blank ones are skipped, and the full name needs both names."""
    entry = lambda kind, v: F.when(F.trim(v) != "", F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    full = F.when((F.trim(first) != "") & (F.trim(last) != ""), F.struct(F.lit("full_name").alias("kind"), F.concat_ws(" ", first, last).alias("value")))
    return F.array_compact(F.array(entry("first_name", first), entry("last_name", last), full, entry("email", email), *[entry(k, v) for k, v in others.items()]))


def user_name(configured: Column, email: Column, local: Column) -> Column:
    """The name a user goes by everywhere: the configured one, else the address, else the local name."""
    return F.coalesce(configured, F.nullif(F.trim(email), F.lit("")), local)


def short_name(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def mode_of(text: Column) -> tuple[Column, Column]:
    """(mode, detail) of a permission mode in any case; unknown ones are "other" with their text."""
    low = F.lower(text)
    known = low.isin("allow", "deny", "none")
    return F.when(known, low).otherwise("other"), F.when(~known, text)


def split_capability(text: Column) -> tuple[Column, Column]:
    """(mode, capability) of "AllowX" or "DenyX"; nulls when it is neither."""
    cut = lambda g: F.nullif(F.regexp_extract(text, r"^(Allow|Deny)(.+)$", g), F.lit(""))
    return cut(1), cut(2)


def to_boolean(text: Column) -> Column:
    """true or false by name; anything else is an error."""
    return F.when(text == "true", True).when(text == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def granted_on_name(kind: Column, catalog: Column, schema: Column, name: Column) -> Column:
    """The dotted name of what a grant is on; a kind that has none is an error."""
    return (
        F.when(kind.isin("TABLE", "VIEW"), F.concat_ws(".", catalog, schema, name))
        .when(kind == "SCHEMA", F.concat_ws(".", catalog, name))
        .when(kind == "DATABASE", catalog)
        .otherwise(F.raise_error(F.concat(F.lit("no grants are read on "), kind)).cast("string"))
    )


def epoch_seconds(at: Column) -> Column:
    """Seconds since 1970 of a time; 0 without one."""
    return F.coalesce(F.unix_timestamp(at), F.lit(0).cast("long"))


def privilege_name(text: Column) -> Column:
    return F.when(text == "REFERENCE USAGE", "REFERENCE_USAGE").otherwise(text)


def json_get(doc: Column, path: str) -> Column:
    """A value at a dotted path of a JSON text; missing ones are an error."""
    got = F.get_json_object(doc, "$." + path)
    return F.coalesce(got, F.raise_error(F.lit(f"no value at {path}")).cast("string"))
