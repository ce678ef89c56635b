"""Removal of repeated word passages, by a compressed FM-index per shard.

Every word covered by ``WINDOW`` consecutive words whose sequence also starts anywhere else is removed. ``repeats``
brings passages that may be equal together in shards. A shard's passages form one sequence of word numbers. Its Burrows-Wheeler
transform is kept as runs: a wavelet tree of bit planes with rank directories over the run heads, where runs begin, and their
lengths summed by symbol (passages of a shard share their cores, so runs are long). The passages stream through
the index from right to left: backward search extends a match to the left while the shard holds it in at least two rows,
and otherwise drops words on the right, down to the next shorter match that more of the shard shares, found in the common
prefixes of neighbouring suffixes. This gives the matching statistics, the longest such match at every word, with each word
searched once; windows that begin where the statistic reaches the threshold are reported.

Words are runs of characters other than ASCII white space, compared by 64-bit hashes. A null text counts as having no
words. Texts with fewer words than a window lose none. Null ids and repeated rows need no special care; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Windows, removal, sha256
from .suffix_dedup import runs_of
from .suffixes import by_rank_doubling
from .words import word_hashes, words_of

WINDOW, ANCHOR, BLOCK = 35, 8, 16


class Plane:
    """Packed bits with a directory of counts."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Ranks in a sequence of small integers."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.planes, level = [], s
        for bit in range(self.depth - 1, -1, -1):
            b = (level >> bit & 1).astype(np.uint8)
            self.planes.append(Plane(b))
            level = np.concatenate([level[b == 0], level[b == 1]])
        # where each symbol's occurrences begin on the last level
        self.base = np.zeros(sigma, np.int64)
        head = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
        self.base[level[head]] = head

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for depth, plane in enumerate(self.planes):
            ones = plane.ones(at)
            bit = symbol >> (self.depth - 1 - depth) & 1
            at = np.where(bit == 1, plane.zeros + ones, at - ones)
        return at - self.base[symbol]


class FMIndex:
    """Suffix intervals of any pattern in a sequence of small integers, by backward search over the runs of its transform."""

    def __init__(self, s: np.ndarray, order: np.ndarray | None = None):
        order = by_rank_doubling(s) if order is None else order
        bwt = s[order - 1]
        sigma = int(s.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))]).astype(np.int64)
        self.starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.heads = bwt[self.starts].astype(np.int32)
        self.tree = WaveletTree(self.heads.astype(np.int64), sigma)
        length = np.diff(np.append(self.starts, len(bwt)))
        by_symbol = np.argsort(self.heads, kind="stable")
        self.lengths = np.concatenate([[0], np.cumsum(length[by_symbol])])  # of runs, by symbol and place
        self.group = np.searchsorted(self.heads[by_symbol], np.arange(sigma))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        run = np.searchsorted(self.starts, at, side="right") - 1
        begin, base = self.starts[run], self.group[symbol]
        whole = self.lengths[base + self.tree.rank(symbol, run)] - self.lengths[base]
        return whole + np.where(self.heads[run] == symbol, at - begin, 0)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, n = self.first[symbol], len(low)
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return start + both[:n], start + both[n:]


class Prefixes:
    """Common prefixes of neighbouring suffixes, with minima over spans of powers of two."""

    def __init__(self, s: np.ndarray, order: np.ndarray):
        n = len(s)
        lcp = np.full(n + 1, -1, np.int32)
        lcp[1:n] = shared_symbols(s, order[:-1], order[1:])
        self.levels = [lcp]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            x, span = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-span], x[span:]))

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) of the longest shorter prefix that a larger interval shares."""
        lcp = self.levels[0]
        depth = np.maximum(lcp[low], lcp[high])
        for j in range(len(self.levels) - 1, -1, -1):
            x, span = self.levels[j], 1 << j
            left = low - span + 1
            go = (left >= 0) & (x[np.maximum(left, 0)] >= depth)
            low = np.where(go, low - span, low)
            go = (high < len(x)) & (x[np.minimum(high, len(x) - 1)] >= depth)
            high = np.where(go, high + span, high)
        return depth.astype(np.int64), low, high


def shared_symbols(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the prefixes that pairs of suffixes share."""
    n, shared, at = len(s), np.zeros(len(a), np.int32), np.arange(len(a))
    k = 0
    while len(at):
        x, y = a[at] + k, b[at] + k
        same = np.maximum(x, y) < n
        same[same] = s[x[same]] == s[y[same]]
        at = at[same]
        shared[at] += 1
        k += 1
    return shared


def matching_statistics(index: FMIndex, prefixes: Prefixes, weight: np.ndarray, s: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every place of the passages (begin, length) in ``s``, the longest match from there that stands in at least two rows;
    ``weight``: rows before each place of the suffix order. All passages advance at once."""
    statistic = np.zeros(len(s), np.int64)
    place, low = begin + length, np.zeros(len(begin), np.int64)  # of the next match to the left; its interval and length
    high, size, lane = np.full(len(begin), len(s), np.int64), np.zeros(len(begin), np.int64), np.flatnonzero(length > 0)
    while len(lane):
        lo, hi = index.extend(s[place[lane] - 1], low[lane], high[lane])
        found = weight[hi] - weight[lo] > 1
        on = lane[found]
        low[on], high[on], size[on], place[on] = lo[found], hi[found], size[on] + 1, place[on] - 1
        statistic[place[on]] = size[on]
        off = lane[~found]
        skip = off[size[off] == 0]
        place[skip] -= 1
        off = off[size[off] > 0]
        size[off], low[off], high[off] = prefixes.parent(low[off], high[off])
        lane = lane[place[lane] > begin[lane]]
    return statistic


def repeated_windows(contents: list[bytes], counts: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Runs of windows, per content (64-bit word hashes), that occur in more than one row; ``counts``: rows of each content."""
    lengths = np.array([len(c) // 8 for c in contents], np.int64)
    _, word = np.unique(np.frombuffer(b"".join(contents), np.uint64), return_inverse=True)
    total = int(lengths.sum()) + len(contents)
    begin = np.cumsum(lengths + 1) - lengths - 1
    s = np.zeros(total + 1, np.int64)  # 1 ends a passage, 0 the sequence
    inner = np.ones(total, bool)
    inner[begin + lengths] = False
    s[:total][inner] = word + 2
    s[begin + lengths] = 1
    order = by_rank_doubling(s)
    rows = np.zeros(total + 1, np.int64)
    rows[:total] = np.repeat(np.minimum(counts, 2), lengths + 1)
    weight = np.concatenate([[0], np.cumsum(rows[order])])
    reached = matching_statistics(FMIndex(s, order), Prefixes(s, order), weight, s, begin, lengths) >= window
    return [runs_of(reached[b : b + k - window + 1]) for b, k in zip(begin.tolist(), lengths.tolist(), strict=True)]


def kept(text: str, covered: list[tuple[int, int]]) -> tuple[int, int, str]:
    words, parts, at = words_of(text), [], 0
    for a, z in covered:
        parts += words[at:a]
        at = z
    parts += words[at:]
    return len(words), len(words) - len(parts), sha256(b" ".join(parts))


WORDS = Windows(lambda text: word_hashes(words_of(text)), WINDOW, ANCHOR, BLOCK)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return removal(docs, WORDS, repeated_windows, kept, "n_words long, n_removed long, kept_sha256 string", ["n_words", "n_removed", "kept_sha256"])


def sql(table: str = "documents") -> str:
    """The same result by grouping all windows, in DuckDB's SQL."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM {table}),
h AS (SELECT rid, generate_subscripts(l, 1) AS i, unnest(l) AS h FROM (SELECT rid, list_transform(range(1, len(w) - {WINDOW - 2}), lambda s: hash(array_to_string(w[s:s + {WINDOW - 1}], ' '))) AS l FROM d WHERE len(w) >= {WINDOW}) q),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
f AS (SELECT rid, i FROM h JOIN again USING (h)),
x AS (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
y AS (SELECT x.rid, x.i, x.word, max(CASE WHEN f.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY x.rid ORDER BY x.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN f ON f.rid = x.rid AND f.i = x.i),
k AS (SELECT rid, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM y GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""
