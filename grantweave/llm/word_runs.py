"""Periodic runs of words: stretches that repeat themselves at least four times.

A run of period q is a stretch of consecutive words in which words q apart are equal, whose smallest period is q, which is at
least max(6, 4 q) words long and which no neighbouring word extends. Words q apart are then equal at 3 q places in a row, so one of the
grid points 0, 3 q, 6 q, ... is among them: over all periods these are about n / 3 ln n pairs (period, grid point) for n words.
Prefix hashes give all pairs of many documents at once their longest common extensions to both sides, by a binary search that
NumPy does for all pairs together. Extensions of the same stretch are one run, with the smallest of its periods. Its words are then
compared themselves; should a hash have led too far, the periods in question are searched by comparing all words.

A null text has no words; words are separated by ASCII white space. Documents go one by one whatever their ids, so null ids and
repeated rows stay as they are. A very long text takes memory in proportion to its words; pairs are worked off in
portions. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import M1, mixed

TIMES, SHORTEST = 4, 6
#: Words of the documents searched together (a longer document goes alone), pairs of a portion.
WORDS, PAIRS = 1 << 17, 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
SPACE = r"[\x20\x09-\x0D]+"


class Interned(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Extensions:
    """Common extensions of places and the places a period later, within their documents, by prefix hashes."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(x), M1)]))
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(mixed(x.astype(np.uint64) + np.uint64(1)) * self.power[:-1])])

    def equal(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from i equal those from i + q, up to chance equality of hashes."""
        s = self.prefix
        with np.errstate(over="ignore"):
            return (s[i + length] - s[i]) * self.power[q] == s[i + q + length] - s[i + q]

    def forward(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The greatest length, up to ``most``, for which ``equal`` holds."""
        got = np.zeros(len(i), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = np.int64(1 << bit)
            fits = np.flatnonzero(got + step <= most)
            at = i[fits] + got[fits]
            got[fits[self.equal(at, q[fits], step)]] += step
        return got

    def backward(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = np.int64(1 << bit)
            fits = np.flatnonzero(got + step <= most)
            at = i[fits] - got[fits] - step
            got[fits[self.equal(at, q[fits], step)]] += step
        return got


def grid(sizes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place) of every grid point, in portions; places count from the first document's first word."""
    periods = np.where(sizes >= SHORTEST, sizes // TIMES, 0)
    doc = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = -(-(sizes[doc] - q) // (3 * q))
    total = np.cumsum(points)
    first = 0
    while first < len(doc):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
        n = points[first:last]
        which = np.repeat(np.arange(first, last), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield doc[which], q[which], begin[doc[which]] + 3 * q[which] * k
        first = last


def distinct(rows: np.ndarray) -> np.ndarray:
    """Columns in ascending order, each once."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])] if rows.shape[1] else rows


def by_comparison(x: np.ndarray, q: int) -> list[tuple[int, int]]:
    """All stretches of period q and sufficient length, without hashes: (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])))
    return [(int(a), int(z) + q) for a, z in zip(edges[::2], edges[1::2], strict=True) if z + q - a >= max(SHORTEST, TIMES * q)]


def verified(x: np.ndarray, s: int, e: int, q: int) -> bool:
    ends = (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q])
    return ends and bool((x[s : e - q] == x[s + q : e]).all())


def runs_of(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    begin = np.cumsum(sizes) - sizes
    x = np.concatenate([*documents, np.empty(0, np.int64)])
    reach = Extensions(x)
    parts = []
    for doc, q, i in grid(sizes, begin):
        hit = np.flatnonzero(x[i] == x[i + q])
        doc, q, i = doc[hit], q[hit], i[hit]
        after, before = begin[doc] + sizes[doc] - q - i, i - begin[doc]  # places to either side that have a word a period later
        half = np.zeros(len(i), bool)  # of 3 q equal places, more than q are on one side of the grid point
        right, left = np.flatnonzero(after >= q), np.flatnonzero(before >= q)
        half[right] = reach.equal(i[right], q[right], q[right])
        left = left[~half[left]]
        half[left] = reach.equal(i[left] - q[left], q[left], q[left])
        hit = np.flatnonzero(half)
        doc, q, i, after, before = doc[hit], q[hit], i[hit], after[hit], before[hit]
        f, b = reach.forward(i, q, after), reach.backward(i, q, before)
        long = np.flatnonzero(f + b + q >= np.maximum(SHORTEST, TIMES * q))
        parts.append(distinct(np.stack([doc, i - b - begin[doc], i + f + q - begin[doc], q])[:, long]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not parts:
        return out
    found = distinct(np.concatenate(parts, axis=1)).T
    groups = np.flatnonzero(np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)])) if len(found) else []
    doubtful: dict[int, set[int]] = {}
    for g, (d, s, e, q) in zip(groups, found[groups].tolist(), strict=True):
        if verified(documents[d], s, e, q):
            out[d].append((s, e - s, q))
        else:
            same = (found[g:, :3] == found[g, :3]).all(axis=1)
            doubtful.setdefault(d, set()).update(found[g:][same][:, 3].tolist())
    for d, periods in doubtful.items():
        least = {(s, s + n): q for s, n, q in out[d]}
        for q in sorted(periods):
            for stretch in by_comparison(documents[d], q):
                least[stretch] = min(q, least.get(stretch, q))
        out[d] = sorted((s, e - s, q) for (s, e), q in least.items())
    return out


def kept(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run repeats: of each run, its first period stays."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _search(words: list[list[str]]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    ids = Interned()
    documents = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in words]
    for w, runs in zip(words, runs_of(documents), strict=True):
        yield len(w), runs, " ".join(kept(w, runs))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the kept words)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held, size = [], [], 0
            for t in b["text"]:
                w = [x.decode() for x in t.encode().split()]
                if held and size + len(w) > WORDS:
                    rows += _search(held)
                    held, size = [], 0
                held.append(w)
                size += len(w)
            rows += _search(held)
            n, runs, collapsed = zip(*rows, strict=True) if rows else ((), (), ())
            runs = [[{"start": s, "length": k, "period": q} for s, k, q in r] for r in runs]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": n, "runs": runs, "collapsed": collapsed})

    return docs.mapInPandas(searched, SCHEMA)


def echoed(doc_id: Column, text: Column) -> Column:
    """The texts the query judges: with h the crc32 of the decimal id and g = floor(h / 10), a text of n > 0 words whose h is a multiple
    of 10 goes on from word a = g % n as repetitions of its p = 1 + floor((n - a) / (3 + g % 8)) words from there. A null id changes nothing."""
    trimmed = F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # one array per text, bound to a name by transform
    echo = F.get(F.transform(F.array(F.split(trimmed, SPACE)), repeated), F.lit(0))
    return F.when((h % 10 == 0) & (trimmed != ""), echo).otherwise(text)


def run_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli of its longest run, runs_sha256, collapsed_sha256."""
    found = find(docs.select("doc_id", echoed(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("n"), r.start.alias("start"), r.period.alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("*", longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("r.start").alias("start"), (-F.col("r.n")).alias("length"), F.col("r.period").alias("period"),
        F.floor(-1000 * F.col("r.n") / F.col("r.period")).alias("exponent_milli"), "runs_sha256", F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def sql(table: str = "documents") -> str:
    """The same result in DuckDB's SQL: grid points by joins, then every place of the periods that are left."""
    word = r"[^\x20\x09-\x0D]+"
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda s, b: list_reduce([xor(s, b)] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
    near = " AND ".join(f"EXISTS (SELECT 1 FROM t x JOIN t y ON y.rid = x.rid AND y.i = x.i + g.q AND y.word = x.word WHERE x.rid = g.rid AND x.i = g.i + g.side * {step})" for step in ("g.q", "(g.q // 2)"))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS w, coalesce({crc}, 1) AS h FROM {table}),
p AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM p),
e AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
t AS (SELECT rid, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM e),
q AS (SELECT rid, n, unnest(range(1, n // {TIMES} + 1)) AS q FROM e),
grid AS (SELECT rid, q, unnest(range(0, n - q, 3 * q)) AS i FROM q),
hit AS (SELECT g.*, unnest([-1, 1]) AS side FROM grid g JOIN t x ON x.rid = g.rid AND x.i = g.i JOIN t y ON y.rid = g.rid AND y.i = g.i + g.q WHERE x.word = y.word),
c AS (SELECT DISTINCT rid, q FROM hit g WHERE {near}),
gaps AS (SELECT c.rid, c.q, x.i FROM c JOIN t x ON x.rid = c.rid JOIN t y ON y.rid = c.rid AND y.i = x.i + c.q WHERE x.word <> y.word UNION ALL SELECT rid, q, -1 FROM c UNION ALL SELECT rid, q, n - q FROM c JOIN e USING (rid)),
s AS (SELECT rid, q, i, lag(i) OVER (PARTITION BY rid, q ORDER BY i) + 1 AS start FROM gaps),
runs AS (SELECT rid, start, i + q - start AS length, min(q) AS period FROM s WHERE i + q - start >= greatest({SHORTEST}, {TIMES} * q) GROUP BY rid, start, i + q),
digest AS (SELECT rid, count(*) AS n_runs, max(struct_pack(length := length, a := -start, b := -period)) AS r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-r.a)::BIGINT AS start, r.length::BIGINT AS length, (-r.b)::BIGINT AS period, (1000 * r.length // -r.b)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN digest USING (rid) LEFT JOIN rest USING (rid)"""
