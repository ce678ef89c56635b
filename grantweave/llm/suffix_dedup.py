"""Removal of long repeated byte strings, by suffix arrays over shards.

Every byte covered by a ``WINDOW``-byte string that also starts anywhere else, in the same document or another, is
removed; matches never cross documents. ``repeats`` brings the strings that may be equal together in shards; each shard's
suffix array is sorted by induction (``suffixes``), and permuted common prefixes of at least a window mark the
strings that occur twice.

A null text counts as empty. Texts shorter than a window lose nothing; copies that are long enough lose everything.
Overlapping repeats within one text count. Null ids, repeated rows and very long texts need no special care; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Windows, removal, sha256
from .suffixes import permuted_prefixes, suffix_array

WINDOW, ANCHOR, BLOCK = 200, 32, 96
END = 0xFF  # no byte of UTF-8 text


def octets(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(z - a)) for a, z in zip(edges[::2], edges[1::2], strict=True)]


def repeated_windows(contents: list[bytes], counts: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Runs of windows, per content, that occur in more than one row; ``counts``: rows of each content."""
    data = bytes([END]).join(contents) + bytes([END])
    lengths = np.array([len(c) + 1 for c in contents], np.int64)
    order = suffix_array(np.frombuffer(data, np.uint8))
    long = permuted_prefixes(data, order, window) >= window  # the suffix before shares a window
    follows = np.zeros(len(data), bool)
    follows[order[:-1]] = long[order[1:]]
    rows = np.repeat(np.minimum(counts, 2), lengths)
    repeated = long | follows | (rows > 1)
    starts = np.cumsum(lengths) - lengths
    # places where a content's windows start; behind them is at least its end, so no run goes on into the next content
    repeated &= np.arange(len(data)) < np.repeat(starts + lengths - window, lengths)
    found: list[list[tuple[int, int]]] = [[] for _ in contents]
    runs = runs_of(repeated)
    owners = np.searchsorted(starts, [a for a, _ in runs], "right") - 1
    for i, first, (a, n) in zip(owners.tolist(), starts[owners].tolist(), runs, strict=True):
        found[i].append((a - first, n))
    return found


def kept(text: str, covered: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    data, parts, at = text.encode("utf-8", "replace"), [], 0
    for a, z in covered:
        parts.append(data[at:a])
        at = z
    parts.append(data[at:])
    rest = b"".join(parts)
    return len(data), len(data) - len(rest), len(covered), sha256(rest)


BYTES = Windows(octets, WINDOW, ANCHOR, BLOCK)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return removal(docs, BYTES, repeated_windows, kept, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def sql(table: str = "documents") -> str:
    """The same result by grouping all windows, in DuckDB's SQL; bytes are pairs of hexadecimal digits there."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM {table}),
n AS (SELECT rid, doc_id, x, len(x) // 2 AS n FROM d),
h AS (SELECT rid, generate_subscripts(l, 1) AS i, unnest(l) AS h FROM (SELECT rid, list_transform(range(0, n - {WINDOW - 1}), lambda s: hash(substring(x, 2 * s + 1, {2 * WINDOW}))) AS l FROM n WHERE n >= {WINDOW}) q),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
f AS (SELECT rid, i, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS run FROM h JOIN again USING (h)),
runs AS (SELECT rid, min(i) - 1 AS a, max(i) - 1 + {WINDOW} AS z FROM f GROUP BY rid, run),
marked AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY rid ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM runs),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY a) AS s FROM marked),
spans AS (SELECT rid, min(a) AS a, max(z) AS z FROM numbered GROUP BY rid, s),
gaps AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
k AS (SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(x), 2 * max(z) + 1) AS kept FROM gaps JOIN n USING (rid) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM n LEFT JOIN k USING (rid)"""
