"""Alignment of two tokenizers over the same texts.

Each worker cuts its texts where both tokenizers start anew whatever follows (before the spaces of a word), so a batch has many
copies of few segments. DuckDB holds the byte intervals of the distinct segments' tokens, for each Arrow batch: an ASOF join finds
the B token that holds an A token's first byte, a range join the B tokens that begin inside it; a token whose end is an end of the other
side, too, closes a group, and a window sum of such ends numbers the groups. Pair counts of a segment go to the documents that hold it
and, summed over the batch, to Spark, which merges them over the corpus.

The corpus-wide counts come back to the documents in two tiers: the ``ENTRIES`` most frequent pairs are broadcast, so no pair that
many documents share becomes a key of a shuffle; what a document holds besides is joined with the whole table of counts.

A null or empty text has no tokens, nor has one whose tokens of either side don't spell space + text (a text that holds U+2581): zeros
and an empty string. Repeated rows and null ids are rows of their own; texts of any length are aligned whole. Ties count as best.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .token_ids import BYTE_LEVEL, LONGEST, PIECES, SPACE, byte_level, pieces
from .word_runs import Interned

#: Pairs whose counts are broadcast (17 bytes each); characters of the texts aligned together (a longer text goes alone); pieces remembered by each tokenizer (three times as many segments).
ENTRIES, TOGETHER, REMEMBERED = 1 << 17, 2 << 20, 1 << 16
#: From the spaces before a word to the next space that follows something else than white space.
SEGMENT = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")
SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, keys array<long>, ns array<long>"

LINKS = """WITH met AS (
    SELECT a.seg, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
    UNION ALL
    SELECT a.seg, a.id AS a, b.id AS b FROM a JOIN b ON b.s > a.s AND b.s < a.e)
SELECT seg, a * {width}::BIGINT + b AS pair, count(*) AS n FROM met GROUP BY seg, pair ORDER BY seg"""

GROUPS = """WITH ends AS (
    SELECT a.seg, 0 AS side, a.i, a.id, b.e IS NOT NULL AS cut FROM a LEFT JOIN b ON a.e = b.e
    UNION ALL
    SELECT b.seg, 1 AS side, b.i, b.id, a.e IS NOT NULL AS cut FROM b LEFT JOIN a ON a.e = b.e),
numbered AS (
    SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ends)
SELECT seg, side, id, cut FROM numbered ORDER BY g, side, i"""

COUNTED = """CREATE OR REPLACE TEMP TABLE counted AS
SELECT doc, pair, sum(o.n * l.n)::BIGINT AS n
FROM (SELECT doc, seg, count(*) AS n FROM occurs GROUP BY doc, seg) o JOIN links l USING (seg) GROUP BY doc, pair"""


class Aligner:
    def __init__(self, first: str, second: str):
        self.a, self.b = byte_level(first, True), pieces(second)
        self.a.known.size = self.b.known.size = REMEMBERED
        self.spelled_a, self.spelled_b = self.a.spelled(), self.b.spelled()
        self.long_a, self.long_b = (np.array([len(x) for x in s], np.int32) for s in (self.spelled_a, self.spelled_b))
        self.names = [f"{i}{end}" for i in range(max(len(self.long_a), len(self.long_b))) for end in ",|;"]  # inside a group, after A's ids, after B's
        self.base = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.recent: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.base.execute("SET preserve_insertion_order = false")

    def segments(self, text: str) -> list[str]:
        """Parts of space + text that both tokenizers encode as they encode the whole; the whole where that isn't sure."""
        if not text:
            return []
        whole = f" {text}"
        return SEGMENT.findall(whole) if self.b.by_word and SPACE not in text and self.a.safe(text) else [whole]

    def intervals(self, ids: list[bytes], long: np.ndarray) -> tuple[np.ndarray, pa.Table]:
        """Tokens of each segment, and all tokens with their byte range in the segments put one after another."""
        n = np.array([len(x) // 4 for x in ids], np.int64)
        every = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        end = np.cumsum(long[every], dtype=np.int32)  # a batch of texts stays under 2^31 bytes
        return n, pa.table({"seg": np.repeat(np.arange(len(ids), dtype=np.int32), n), "i": np.arange(len(every), dtype=np.int32), "id": every, "s": end - long[every], "e": end})

    def spelt(self, ids: list[bytes], spelled: list[bytes], segments: list[str]) -> np.ndarray:
        """Which segments their tokens spell; all are compared at once, and one by one only where that fails."""

        def text(x: bytes) -> bytes:
            return b"".join(map(spelled.__getitem__, np.frombuffer(x, "<u4").tolist()))

        if text(b"".join(ids)) == "".join(segments).encode():
            return np.ones(len(segments), bool)
        return np.array([text(x) == s.encode() for s, x in zip(segments, ids, strict=True)], bool)

    def loaded(self, **tables: pa.Table) -> None:
        for name, rows in tables.items():
            self.base.register(f"{name}_rows", rows)
            self.base.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM {name}_rows")
            self.base.unregister(f"{name}_rows")

    def dropped(self, *names: str) -> None:
        for name in names:
            self.base.execute(f"DROP TABLE {name}")

    def aligned(self, segments: list[str]) -> list[tuple]:
        """Of each segment: whether its tokens spell it, tokens of A and B, groups, the groups shown, pairs and their links (whole numbers of 8 bytes)."""
        ids_a, ids_b = self.a.many(segments), self.b.many(segments)
        fine = self.spelt(ids_a, self.spelled_a, segments) & self.spelt(ids_b, self.spelled_b, segments)
        for i in np.flatnonzero(~fine).tolist():
            ids_a[i] = ids_b[i] = b""
        (n_a, a), (n_b, b) = self.intervals(ids_a, self.long_a), self.intervals(ids_b, self.long_b)
        self.loaded(a=a, b=b)
        links = self.base.execute(LINKS.format(width=len(self.long_b))).fetchnumpy()
        groups = self.base.execute(GROUPS).fetchnumpy()
        self.dropped("a", "b")
        every = np.arange(len(segments) + 1)
        n_groups = np.bincount(groups["seg"][groups["cut"] & (groups["side"] == 0)], minlength=len(segments))
        names = list(map(self.names.__getitem__, (3 * groups["id"] + np.where(groups["cut"], 1 + groups["side"], 0)).tolist()))
        bounds = np.searchsorted(groups["seg"], every).tolist()
        cuts = (8 * np.searchsorted(links["seg"], every)).tolist()
        pair, n = links["pair"].astype(np.int64).tobytes(), links["n"].astype(np.int64).tobytes()
        parts = zip(fine.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), bounds[:-1], bounds[1:], cuts[:-1], cuts[1:], strict=True)
        return [(f, x, y, g, "".join(names[i:j]), pair[u:v], n[u:v]) for f, x, y, g, i, j, u, v in parts]

    def remembered(self, segments: list[str]) -> list[tuple]:
        """``aligned``, but for what the worker aligned lately. Of two generations of segments, the older one is given up when the newer is full."""
        found = [self.recent.get(s) or self.older.get(s) for s in segments]
        new = [i for i, r in enumerate(found) if r is None]
        for i, r in zip(new, self.aligned([segments[i] for i in new]), strict=True):
            found[i] = r
        if len(self.recent) + len(segments) > 3 * REMEMBERED:
            self.recent, self.older = {}, self.recent
        self.recent.update((s, r) for s, r in zip(segments, found, strict=True) if len(s) <= LONGEST)
        return found

    def __call__(self, texts: list[str], shown: bool) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Per text its columns; the pairs of all texts and their counts."""
        gc.disable()  # many small objects, but no cycles: looking for them takes a sixth of the time
        try:
            return self.batch(texts, shown)
        finally:
            gc.enable()

    def batch(self, texts: list[str], shown: bool) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        known = Interned()
        parts = [np.fromiter(map(known.__getitem__, s), np.int32, len(s)) for s in map(self.segments, texts)]
        records = self.remembered(list(known))
        fine, n_a, n_b, n_groups, strings, pairs, ns = map(list, zip(*records, strict=True)) if records else ([],) * 7
        fine, *sums = np.array(fine, bool), *(np.array(x, np.int64) for x in (n_a, n_b, n_groups))
        parts = [p if fine[p].all() else p[:0] for p in parts]
        sizes = np.array([len(p) for p in parts], np.int64)
        seg = np.repeat(np.arange(len(records), dtype=np.int32), np.array([len(x) // 8 for x in pairs], np.int64))
        links = pa.table({"seg": seg, "pair": np.frombuffer(b"".join(pairs), np.int64), "n": np.frombuffer(b"".join(ns), np.int64)})
        self.loaded(links=links, occurs=pa.table({"doc": np.repeat(np.arange(len(parts), dtype=np.int32), sizes), "seg": np.concatenate([*parts, np.empty(0, np.int32)])}))
        self.base.execute(COUNTED)
        found = self.base.execute("SELECT doc, pair, n FROM counted ORDER BY doc").fetchnumpy()
        whole = self.base.execute("SELECT pair, sum(n)::BIGINT AS n FROM counted GROUP BY pair").fetchnumpy()
        self.dropped("links", "occurs", "counted")
        cuts = np.searchsorted(found["doc"], np.arange(1, len(parts)))
        keys, ns = np.split(found["pair"], cuts), np.split(found["n"], cuts)
        lines = ["".join(map(strings.__getitem__, p.tolist()))[:-1] for p in parts]
        columns = {name: [int(x[p].sum()) for p in parts] for name, x in zip(("n_a", "n_b", "n_groups"), sums, strict=True)}
        columns |= {"n_links": [int(x.sum()) for x in ns], "groups": lines if shown else [None] * len(lines), "groups_sha256": [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines]}
        return columns | {"keys": keys, "ns": ns}, whole["pair"], whole["n"]


@lru_cache(maxsize=1)
def _worker(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str = BYTE_LEVEL, second: str = PIECES, shown: bool = False) -> DataFrame:
    """One row per document: row, doc_id, n_a, n_b, n_groups, n_links, groups (if ``shown``: A's ids, then B's, of every group),
    groups_sha256, and its pairs ``keys`` (A's id times B's vocabulary plus B's id) with their number of links ``ns``. Besides, rows without a number that
    hold the pair counts of whole batches. It is stored, since several questions are put to it."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a = batch["text"].to_pylist(), 0
            ends = np.cumsum([len(t) for t in texts])
            while a < len(texts):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
                columns, keys, ns = _worker(first, second)(texts[a:z], shown)
                columns |= {"row": batch["row"][a:z].to_pylist(), "doc_id": batch["doc_id"][a:z].to_pylist()}
                for name in columns:
                    columns[name].append(None) if name not in ("keys", "ns") else None
                columns["keys"], columns["ns"] = lists([*columns["keys"], keys]), lists([*columns["ns"], ns])
                kinds = {"groups": pa.string(), "groups_sha256": pa.string(), "keys": pa.list_(pa.int64()), "ns": pa.list_(pa.int64())}
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "keys", "ns"]
                yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) else pa.array(c, kinds.get(n, pa.int64())) for n in names], names=names)
                a = z

    return materialize(docs.mapInArrow(aligned, SCHEMA))


def pair_counts(aligned: DataFrame, second: str = PIECES) -> DataFrame:
    """Corpus-wide links of every pair of ids: a, b, n, best (no other A id has more links with b), key."""
    width = len(pieces(second).names)
    pairs = aligned.where("row is null").select(F.explode(F.arrays_zip("keys", "ns")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.ns").alias("n"))
    pairs = materialize(pairs.select(F.floor(F.col("key") / width).alias("a"), (F.col("key") % width).alias("b"), "n", "key"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))  # at most one row for each id of B
    return pairs.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"), "key")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align(docs)
    spark = docs.sparkSession
    counts = materialize(pair_counts(aligned))
    top = counts.orderBy(F.desc("n"), "key").limit(ENTRIES).select("key", "n", "best").toPandas().sort_values("key")
    tier = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("key", "n", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = tier.value
        for batch in batches:
            keys, ns = batch["keys"].values.to_numpy(), batch["ns"].values.to_numpy()
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            offsets = batch["keys"].offsets.to_numpy()
            sums = []
            for value in (n, best):
                total = np.concatenate([[0], np.cumsum(np.where(hit, value[at] * ns, 0) if len(known) else np.zeros(len(keys), np.int64))]).astype(np.int64)
                sums.append(total[offsets[1:]] - total[offsets[:-1]])
            missed = np.concatenate([[0], np.cumsum(~hit)])[offsets].astype(np.int32)
            rest = [pa.ListArray.from_arrays(missed, x[~hit]) for x in (keys, ns)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(sums[0]), pa.array(sums[1]), *rest], names=["row", "count_sum", "n_best", "keys", "ns"])

    real = aligned.where("row is not null")
    tiered = materialize(real.select("row", "keys", "ns").mapInArrow(looked_up, "row long, count_sum long, n_best long, keys array<long>, ns array<long>"))
    rare = tiered.select("row", F.explode(F.arrays_zip("keys", "ns")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.ns").alias("m"))
    rest = rare.join(counts, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("m")).alias("c"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("m"))
    whole = real.drop("keys", "ns", "groups").join(tiered.drop("keys", "ns"), "row").join(rest, "row", "left")
    more = {"n_best": "m", "count_sum": "c"}
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in more.items()], "groups_sha256")
