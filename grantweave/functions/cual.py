"""Uniform names of assets: scheme://authority/segment/...?type=T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(cual: Column) -> Column:
    return F.regexp_extract(cual, r"^([^:/?#]+)://", 1)


def prefix(cual: Column) -> Column:
    """Scheme and authority: what a connector owns."""
    return F.substring_index(cual, "/", 3)


def asset_type(cual: Column) -> Column:
    """The ``type`` parameter; null without one."""
    return F.nullif(F.regexp_extract(cual, r"[?&]type=([^&#]*)", 1), F.lit(""))


def segments(cual: Column) -> Column:
    """Raw path segments, without empty ones."""
    path = F.regexp_extract(cual, r"^[^:/?#]+://[^/?#]*/?([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def decode(segment: Column) -> Column:
    """Percent-decoding that leaves + as it is."""
    return F.url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))


def path(cual: Column) -> Column:
    return F.transform(segments(cual), decode)


def encode(segment: Column) -> Column:
    """Percent-encoding as in paths: a blank is %20, and * and ~ follow the general rule for urls."""
    out = F.url_encode(segment)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def build(owner: Column, parts: Column, kind: Column | None = None) -> Column:
    """owner is a prefix such as scheme://authority; parts an array of plain segments."""
    base = F.concat(owner, F.lit("/"), F.array_join(F.transform(parts, encode), "/"))
    return base if kind is None else F.when(kind.isNull(), base).otherwise(F.concat(base, F.lit("?type="), encode(kind)))


def warehouse(account: Column, *parts: Column) -> Column:
    """A warehouse object: database, schema, object; null parts are left out."""
    return build(F.concat(F.lit("snowflake://"), account, F.lit(".snowflakecomputing.com")), F.array_compact(F.array(*parts)))


def relation(account: Column, name: Column) -> Column:
    """A relation of the transformation tool, by its dotted name, as the warehouse object it becomes; without a type."""
    from .names import model_parts

    return build(F.concat(F.lit("snowflake://"), account, F.lit(".snowflakecomputing.com")), model_parts(name))


def bi(server: Column, parts: Column, kind: Column) -> Column:
    """An asset of the BI server: its folders from the top project down, its own name, and its type."""
    return build(F.concat(F.lit("tableau://"), server), parts, kind)
