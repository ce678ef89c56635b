"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised to lower-case words of letters, digits and non-ASCII bytes, one space
apart. A text holds an item if it holds a passage of it: ``PASSAGE`` bytes of the item's normal form, or all of a shorter
one, with at most floor(``RATE`` * bytes) edits. Passages begin every ``STRIDE`` bytes and at the item's end, so any verbatim
stretch of PASSAGE + STRIDE - 1 bytes holds one. This is one rule for items of every length; what is reported of an
item is its passage with the fewest edits (the first such place in the text), with its place in the item and in the text.

By the q-gram lemma an occurrence of a passage of m bytes with e edits shares at least m - q + 1 - q * e q-grams
with the text, all within e + 1 neighbouring diagonals. Shared q-grams are counted in diagonal bands of width
2 (e + 1) that overlap by half, so some band holds a whole occurrence; bands that reach the bound are verified by
banded alignment of the passage against the band's region. Where the bound is below 1 (13 to 15 bytes, one edit), one half
of the item stands unchanged and proposes the place instead.

The benchmark is the stated query set: the driver reads it in blocks of about ``BLOCK`` bytes of passages (at least one item),
and each block is one round over the documents, so neither driver nor workers ever hold more than a block. The documents
are scanned map-side and never shuffled.

A null or empty text matches nothing; items whose normal form is shorter than q bytes say too little to tell a copy from
chance and match nothing, nor do null items or items without id; repeated rows and ids are treated one by one; other columns
are kept; empty tables give empty results. Very long texts are searched whole, in overlapping pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

Q, RATE, PASSAGE, STRIDE, HALF, BLOCK, PIECE, EXPANDED = 8, 0.08, 200, 25, 6, 4 << 20, 1 << 20, 1 << 20
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FIELDS = ("item_id", "edits", "start", "end", "item_start", "item_end")
HITS = "array<struct<item_id:bigint,edits:int,start:bigint,end:bigint,item_start:bigint,item_end:bigint>>"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's fraction


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(TABLE).split())


def grams(data: bytes) -> np.ndarray:
    """Every q-gram of 8 bytes as one integer."""
    n = len(data) - Q + 1
    return np.ndarray((n,), "<u8", data, 0, (1,)) if n > 0 else np.empty(0, "<u8")


def passages_of(data: bytes) -> list[tuple[int, bytes]]:
    """(place, passage) of an item's normal form."""
    last = max(0, len(data) - PASSAGE)
    return [(s, data[s : s + PASSAGE]) for s in [*range(0, last, STRIDE), last]] if len(data) >= Q else []


class Index:
    """The q-grams of one block of the benchmark, with the items and places where they stand."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.windows: list[bytes] = []
        self.of: list[tuple[int, int, int]] = []  # (number of the item, its id, the passage's place in it)
        for i, (item, data) in enumerate(items):
            for place, w in passages_of(data):
                self.windows.append(w)
                self.of.append((i, item, place))
        length = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.edits = (RATE * length).astype(np.int64)
        self.least = np.maximum(length - Q + 1 - Q * self.edits, 1)
        self.half = self.edits + 1
        halves = [(w[o : o + HALF], i, o) for i, w in enumerate(self.windows) if len(w) - Q + 1 - Q * self.edits[i] < 1 for o in (0, len(w) - HALF)]
        self.halves: dict[bytes, list[tuple[int, int]]] = {}
        for part, i, o in halves:
            self.halves.setdefault(part, []).append((i, o))
        gram = np.concatenate([grams(w) for w in self.windows] or [np.empty(0, "<u8")])
        owner = np.repeat(np.arange(len(length)), np.maximum(length - Q + 1, 0))
        place = np.concatenate([np.arange(len(w) - Q + 1) for w in self.windows] or [np.empty(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        bits = max(16, int(np.ceil(np.log2(16 * len(self.gram) + 1))))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[self.slot(self.gram)] = True

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * MULTIPLIER) >> self.shift

    def bands(self, data: bytes) -> list[tuple[int, int]]:
        """(window, first diagonal) of each band that reaches the window's bound."""
        gram = grams(data)
        if not len(gram) or not len(self.gram):
            return []
        at = np.flatnonzero(self.seen[self.slot(gram)])
        key = np.searchsorted(self.gram, gram[at])
        hit = self.gram[np.minimum(key, len(self.gram) - 1)] == gram[at]
        at, key = at[hit], key[hit]
        n, parts = self.count[key], []
        cuts = np.searchsorted(np.cumsum(n), np.arange(EXPANDED, n.sum() + EXPANDED, EXPANDED))
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):  # common q-grams meet many places: a bounded number at a time
            k = n[a:z]
            each = np.repeat(self.first[key[a:z]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            window, half = self.owner[each], self.half[self.owner[each]]
            band = (np.repeat(at[a:z], k) - self.place[each] + PASSAGE) // half  # never negative
            parts.append(np.unique(np.concatenate([window << 32 | band, window << 32 | np.maximum(band - 1, 0)]), return_counts=True))
        code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        shared = np.bincount(place, np.concatenate([c for _, c in parts]))
        code = code[shared >= self.least[code >> 32]]
        window = code >> 32
        return list(zip(window.tolist(), ((code & 0xFFFFFFFF) * self.half[window] - PASSAGE).tolist(), strict=True))

    def near_halves(self, data: bytes) -> list[tuple[int, int]]:
        """(window, first diagonal) where a half of a window without a bound stands."""
        found = set()
        for part, owners in self.halves.items():
            at = data.find(part)
            while at >= 0:
                found |= {(w, at - o - 1) for w, o in owners}
                at = data.find(part, at + 1)
        return sorted(found)

    def search(self, data: bytes) -> list[tuple[int, int, int, int, int, int]]:
        """FIELDS of every item that the text holds, by its passage with the fewest edits, of equals the first in the text."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for begin in range(0, max(1, len(data)), PIECE):
            piece = data[begin : begin + PIECE + 2 * PASSAGE]
            inexact = []
            for w, diagonal in self.bands(piece) + self.near_halves(piece):
                i, e, item = self.of[w][0], int(self.edits[w]), self.windows[w]
                lo = max(0, diagonal - e)
                at = piece.find(item, lo, max(0, diagonal + 3 * e + 3) + len(item))
                if at >= 0:
                    best[i] = min((0, begin + at, begin + at + len(item), w), best.get(i, (1,)))
                else:
                    inexact.append((w, diagonal))
            for w, diagonal in inexact:  # an item that stands unchanged needs no alignment, others none beyond their best
                i, e = self.of[w][0], int(self.edits[w])
                known = best.get(i, (e, 1 << 62))
                if known[0] and (found := align(self.windows[w], piece, diagonal - e, 4 * e + 3, min(e, known[0]))):
                    edits, s, t = found
                    best[i] = min((edits, begin + s, begin + t, w), known)
        out = []
        for edits, s, t, w in (best[i] for i in sorted(best)):
            _, item, place = self.of[w]
            out.append((item, edits, s, t, place, place + len(self.windows[w])))
        return out


def align(item: bytes, text: bytes, lo: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Least edits that turn ``item`` into a piece of ``text`` within the diagonals lo .. lo + width - 1, with the
    piece's start and end; None beyond ``most`` edits. The band's cells of a row are computed at once."""
    near = text.find(item, max(0, lo), max(0, lo) + width + len(item))
    if near >= 0:
        return 0, near, near + len(item)
    one, far = 1 << 40, 1 << 60
    place = lo + np.arange(width)
    ramp = np.arange(width, dtype=np.int64) * one
    row = np.where((place >= 0) & (place <= len(text)), np.maximum(place, 0), far).astype(np.int64)  # edits * one + start
    padded = np.full(len(item) + width, -1, dtype=np.int16)
    a, b = max(0, lo), min(len(text), lo + len(padded))
    if a < b:
        padded[a - lo : b - lo] = np.frombuffer(text, np.uint8)[a:b]
    for i, c in enumerate(item):
        new = row + np.where(padded[i : i + width] == c, 0, one)
        new[:-1] = np.minimum(new[:-1], row[1:] + one)
        row = np.minimum.accumulate(new - ramp) + ramp
        row[place + i + 1 > len(text)] = far
        if row.min() // one > most:
            return None
    j = int(np.argmin(row))
    edits, start = divmod(int(row[j]), one)
    return (edits, start, lo + j + len(item)) if edits <= most else None


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's normal forms in lists of about BLOCK bytes of passages (at least one item)."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        data = normal(row.t)
        cost = len(data) * (PASSAGE // STRIDE) if len(data) > PASSAGE else len(data)
        if held and size + cost > BLOCK:
            yield held
            held, size = [], 0
        held.append((row.i, data))
        size += cost
    if held:
        yield held


def find(docs: DataFrame, items: list[tuple[int, bytes]], text: str, out: str) -> DataFrame:
    """``docs`` with an array of the items of one block that each text holds."""
    small_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(Index(items))

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        index = bc.value
        return pd.Series([[dict(zip(FIELDS, x, strict=True)) for x in index.search(normal(t))] for t in texts.fillna("")], dtype=object)

    return docs.withColumn(out, hits.asNondeterministic()(F.col(text)))  # so that no filter evaluates it a second time


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item in it: doc_id, item_id, edits, start and end in the document's normal form, item_start and item_end in the item's."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rounds, held = [], list(islice(todo := blocks(benchmark, item_id, item_text), 1))
    while held:
        found = find(docs, held[0], "text", "hits").select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        held = list(islice(todo, 1))
        rounds.append(materialize(found) if held or rounds else found)  # a single block needs no table of its own
    none = docs.where("false").select("doc_id", F.explode(F.array().cast(HITS)).alias("h")).select("doc_id", "h.*")
    return reduce(DataFrame.union, rounds) if rounds else none


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns; each round works on what the one before left."""
    columns, hits = docs.columns, "hits_" + "_".join(docs.columns)
    left, rounds = docs, 0
    for items in blocks(benchmark, item_id, item_text):
        left = materialize(left) if rounds else left
        left, rounds = find(left, items, text, hits).where(F.size(hits) == 0).select(*columns), rounds + 1
    return left
