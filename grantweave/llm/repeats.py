"""Finding repeated windows across all documents: how windows that may be equal meet in one shard.

A window is ``W`` consecutive symbols of one text. Each window has an anchor, the K-gram in it with the least hash
(leftmost of equals), so equal windows have equal anchors. Consecutive windows with one anchor form a segment.

1. One pass counts, over all texts, the segments of each anchor and whether their contents are all equal. Windows of an anchor that
   occurs once occur once.
2. A second pass takes the segments of anchors that recur, which meet by anchor if all are equal. Otherwise they are cut into blocks of
   ``B`` neighbouring places relative to the anchor. A
   block's windows all hold a common core, and equal windows have equal cores, so blocks meet by core: an
   anchor that a large part of all texts share (a common line, say) is split by its surroundings. Recurring anchors are known by
   Bloom filters sized by their number (errors only cost work); beyond ``FILTERED`` anchors segments join the anchors instead.
3. Segments and blocks that recur go to shards, each different content once with its number of rows (at least two where there
   are more). Cores with over ``SPLIT`` different contents are cut into narrower blocks, whose cores hold more of the
   surroundings, down to single windows, so no core fills a task. A shard's index (a suffix array or an FM-index, see the
   callers) decides for every window whether it occurs in more than one row.
4. Intervals of repeated windows return to the texts; covered symbols are removed.

Texts are known by two 64-bit hashes, so copies, null ids and repeated rows need no ids, and copies share results. A task takes
at most two copies of a text and one content of a kind: more can't change what is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, in_bloom, sized
from .common import materialize, small_batches, text_key, whole_groups
from .words import gram_hashes

PIECE = 1 << 22
#: Bytes of contents that one index is built over, about; different contents of a core beyond which it is cut up; anchors beyond
#: which they are joined instead of filtered; texts and contents that a task remembers.
SHARD, SPLIT, FILTERED, SEEN = 1 << 19, 4096, 1 << 24, 1 << 18


class Windows:
    """Segments and blocks of one kind of symbols: ``symbols(text)`` gives an array, windows have ``w`` of them, anchors ``k``, blocks ``b`` places."""

    def __init__(self, symbols: Callable[[str], np.ndarray], w: int, k: int, b: int):
        self.symbols, self.w, self.k, self.b = symbols, w, k, b

    @property
    def width(self) -> int:
        """Bytes of a symbol."""
        return self.symbols("").itemsize

    def segments(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor's place, anchor's hash) of each segment."""
        out = []
        for at in range(0, max(0, len(s) - self.w + 1), PIECE):
            part = s[at : at + PIECE + self.w - 1]
            n, g = len(part) - self.w + 1, gram_hashes(part, self.k)
            code = g & ~np.uint64(0xFFFFFF) | np.arange(len(g), dtype=np.uint64)
            wide, span = self.w - self.k + 1, 1
            while span * 2 <= wide:
                code = np.minimum(code[:-span], code[span:])
                span *= 2
            code = np.minimum(code[:n], code[wide - span : wide - span + n])
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            place = (code[first] & np.uint64(0xFFFFFF)).astype(np.int64)
            out.append((first + at, np.diff(np.append(first, n)), place + at, g[place]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)

    def content(self, data: bytes, width: int, first: int, n: int) -> bytes:
        return data[first * width : (first + n - 1 + self.w) * width]

    def hashes(self, data: bytes, width: int, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the contents of runs of windows."""
        return signed(np.array([xxhash.xxh3_64_intdigest(self.content(data, width, f, k)) for f, k in zip(first.tolist(), n.tolist(), strict=True)], np.uint64))

    def blocks(self, first: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(segment, block, first window, number of windows): windows whose distance to the anchor falls in one block."""
        low, high = (place - (first + n - 1)) // self.b, (place - first) // self.b  # blocks of the last and the first window
        count = high - low + 1
        segment = np.repeat(np.arange(len(first)), count)
        block = np.repeat(low, count) + np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        a = np.maximum(first[segment], place[segment] - (block * self.b + self.b - 1))
        z = np.minimum(first[segment] + n[segment] - 1, place[segment] - block * self.b)
        return segment, block, a, z - a + 1

    def core(self, data: bytes, width: int, place: int, block: int) -> bytes:
        """What all windows of the block hold, whether or not the segment has all of the block's windows."""
        return data[(place - block * self.b) * width : (place - block * self.b - self.b + 1 + self.w) * width]


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


class Twice:
    """Lets a key pass twice, within a bounded memory."""

    def __init__(self):
        self.seen: dict = {}

    def __call__(self, key) -> bool:
        if len(self.seen) > SEEN:
            self.seen.clear()
        n = self.seen.get(key, 0)
        self.seen[key] = n + 1
        return n < 2


def segments_of(docs: DataFrame, kind: Windows, columns: str) -> DataFrame:
    """The segments of all texts, at most two copies of a text a task: k1, k2, first (window), m (the anchor's hash), c (the content's), or some of these."""
    names = [c.split()[0] for c in columns.split(", ")]

    def scan(batches):
        twice = Twice()
        for b in batches:
            out: dict[str, list] = {c: [np.empty(0, np.int64)] for c in names}
            for k1, k2, text in zip(b["k1"].tolist(), b["k2"].tolist(), b["text"], strict=True):
                if not twice((k1, k2)):
                    continue
                s = kind.symbols(text)
                first, n, _, g = kind.segments(s)
                every = {"k1": np.full(len(g), k1), "k2": np.full(len(g), k2), "first": first, "m": signed(g)}
                if "c" in names:
                    every["c"] = kind.hashes(s.tobytes(), s.itemsize, first, n)
                for c in names:
                    out[c].append(every[c])
            yield pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    return docs.mapInPandas(scan, columns)


def recurring(docs: DataFrame, kind: Windows) -> DataFrame:
    """(m, pure): anchors that more than one segment has; pure: whose contents are all equal."""
    counted = segments_of(docs, kind, "m long, c long").groupBy("m").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    return counted.where("n > 1").select("m", (F.col("low") == F.col("high")).alias("pure"))


BLOCKS = "first int, n int, d int, q long, c long, content binary"


def block_columns(kind: Windows, data: bytes, width: int, first: np.ndarray, n: np.ndarray, place: np.ndarray) -> dict[str, list]:
    """The blocks of some segments: the segment's number, first window, number of windows, distance from there to the anchor, hashes of core and content, content."""
    segment, block, a, count = kind.blocks(first, n, place)
    anchor = place[segment]
    cores = [kind.core(data, width, p, x) for p, x in zip(anchor.tolist(), block.tolist(), strict=True)]
    own = [kind.content(data, width, x, y) for x, y in zip(a.tolist(), count.tolist(), strict=True)]
    q = np.array([xxhash.xxh3_64_intdigest(x) for x in cores], np.uint64) + block.astype(np.uint64)
    c = np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64)
    return {"segment": segment, "first": a, "n": count, "d": anchor - a, "q": signed(q), "c": signed(c), "content": own}


def occurrences(docs: DataFrame, kind: Windows) -> DataFrame:
    """(k1, k2, BLOCKS) of the segments whose anchors recur, whole ones with the anchor's hash as ``q``; a task gives a content once, then null."""
    spark = docs.sparkSession
    anchors = materialize(recurring(docs, kind))
    known = anchors.count()
    listed = known > FILTERED
    if listed:
        found = segments_of(docs, kind, "k1 long, k2 long, first int, m long").join(anchors, "m").select("k1", "k2", "first", "pure").distinct()
        one = lambda pure: F.collect_list(F.when(F.col("pure") == pure, F.col("first")))
        docs = docs.join(found.groupBy("k1", "k2").agg(one(True).alias("pure"), one(False).alias("mixed")), ["k1", "k2"])  # of one text
    else:
        docs = docs.withColumns({"pure": F.lit(None).cast("array<int>"), "mixed": F.lit(None).cast("array<int>")})
        unlike = anchors.where("NOT pure")
        filters = spark.sparkContext.broadcast((bloom(anchors, "m", sized(known)), bloom(unlike, "m", sized(unlike.count()))))  # 4 bytes an anchor, FILTERED at most

    def cut(batches):
        twice, seen = Twice(), set()
        for batch in batches:
            frames = []
            for k1, k2, text, pure, mixed in zip(batch["k1"].tolist(), batch["k2"].tolist(), batch["text"], batch["pure"], batch["mixed"], strict=True):
                if not twice((k1, k2)):
                    continue
                s = kind.symbols(text)
                first, n, place, g = kind.segments(s)
                m = signed(g)
                if listed:
                    whole, split = np.flatnonzero(np.isin(first, pure)), np.flatnonzero(np.isin(first, mixed))
                else:
                    hit = np.flatnonzero(in_bloom(filters.value[0], m))
                    part = in_bloom(filters.value[1], m[hit])
                    whole, split = hit[~part], hit[part]
                if len(whole) or len(split):
                    data, width = s.tobytes(), s.itemsize
                    f, k = first[whole], n[whole]
                    own = {"first": f, "n": k, "d": place[whole] - f, "q": m[whole], "c": kind.hashes(data, width, f, k), "content": [kind.content(data, width, x, y) for x, y in zip(f.tolist(), k.tolist(), strict=True)]}
                    blocks = block_columns(kind, data, width, first[split], n[split], place[split])
                    frames.append((k1, k2, {c: [own[c], blocks[c]] for c in own}))
            if frames:
                sizes = [len(x["content"][0]) + len(x["content"][1]) for _, _, x in frames]
                columns = {c: np.concatenate([part for _, _, x in frames for part in x[c]]) for c in ("first", "n", "d", "q", "c")}
                contents = [y for _, _, x in frames for part in x["content"] for y in part]
                new = [not (x in seen or seen.add(x)) for x in zip(columns["q"].tolist(), columns["c"].tolist(), strict=True)]
                if len(seen) > SEEN:
                    seen.clear()
                yield pd.DataFrame(
                    {
                        "k1": np.repeat([k1 for k1, _, _ in frames], sizes), "k2": np.repeat([k2 for _, k2, _ in frames], sizes),
                        **{c: v.astype(np.int32 if c in ("first", "n", "d") else np.int64) for c, v in columns.items()},
                        "content": pd.Series([y if fresh else None for y, fresh in zip(contents, new, strict=True)], dtype=object),
                    }
                )

    return docs.mapInPandas(cut, f"k1 long, k2 long, {BLOCKS}")


def indexed(contents: DataFrame, kind: Windows, find, b: int) -> DataFrame:
    """(q, c, at, count): runs of windows that occur in more than one row, of stored contents (q, c, d, times, content) in blocks of ``b`` places."""
    spark = contents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = contents.groupBy("q").agg(F.count("*").alias("unlike"), F.sum("times").alias("rows")).where("rows > 1")
    sizes = materialize(sizes.select("q", (F.col("unlike") > (SPLIT if b > 1 else 1 << 62)).alias("hot")))
    few = contents.join(sizes.where("NOT hot"), "q", "left_semi").repartition(parts, "q").sortWithinPartitions("q", "c")

    def search(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            found = find([x[2] for x in held], np.array([x[3] for x in held]))
            return pd.DataFrame([(q, c, a, n) for (q, c, _, _), runs in zip(held, found, strict=True) for a, n in runs], columns=["q", "c", "at", "count"])

        for frame in whole_groups(batches, ["q"]):
            held += list(zip(frame["q"], frame["c"], frame["content"], frame["times"], strict=True))
            size += int(frame["content"].str.len().sum())
            if size >= SHARD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    runs = few.select("q", "c", "content", "times").mapInPandas(search, "q long, c long, at int, count int")
    hot = sizes.where("hot")
    if b == 1 or not hot.limit(1).count():
        return runs
    narrow = Windows(kind.symbols, kind.w, kind.k, max(1, b // 4))

    def cut(batches):
        for batch in batches:
            # the contents of a batch side by side, each a segment of its own
            width, n = kind.width, batch["content"].str.len().to_numpy(np.int64) // kind.width
            at = np.cumsum(n) - n
            blocks = block_columns(narrow, b"".join(batch["content"]), width, at, n - kind.w + 1, at + batch["d"].to_numpy(np.int64))
            own = blocks.pop("segment")
            blocks["first"] = blocks["first"] - at[own]
            frame = pd.DataFrame({"q0": batch["q"].to_numpy()[own], "c0": batch["c"].to_numpy()[own], "times": batch["times"].to_numpy()[own], **blocks})
            yield frame.astype({"first": "int32", "n": "int32", "d": "int32"})

    pieces = materialize(contents.join(hot, "q", "left_semi").select("q", "c", "d", "times", "content").mapInPandas(cut, f"q0 long, c0 long, times long, {BLOCKS}"))
    again = materialize(pieces.groupBy("q", "c").agg(F.first("d").alias("d"), F.sum("times").alias("times"), F.first("content").alias("content")))
    inner = pieces.select("q0", "c0", "first", "q", "c").join(indexed(again, kind, find, narrow.b), ["q", "c"])
    return runs.unionByName(inner.select(F.col("q0").alias("q"), F.col("c0").alias("c"), (F.col("first") + F.col("at")).alias("at"), "count"))


def repeated(docs: DataFrame, kind: Windows, find: Callable[[list[bytes], np.ndarray], list[list[tuple[int, int]]]]) -> DataFrame:
    """(k1, k2, runs) per text that has repeated windows; runs: array of (first window, number of windows).

    ``docs``: (k1, k2, text), copies allowed. ``find(contents, rows)`` gives, for each content of a shard, the runs of
    windows that occur in more than one row of the shard.
    """
    small_batches(docs.sparkSession)
    rows = materialize(occurrences(docs, kind))
    # equal contents are one row from here on, before anything meets by core
    kinds = materialize(rows.groupBy("q", "c").agg(F.count("*").alias("times")))
    cores = kinds.groupBy("q").agg(F.sum("times").alias("rows")).where("rows > 1").select("q")
    wanted = materialize(kinds.join(cores, "q", "left_semi"))
    contents = materialize(rows.where("content IS NOT NULL").select("q", "c", "d", "content").join(wanted, ["q", "c"]).dropDuplicates(["q", "c"]))
    runs = materialize(indexed(contents, kind, find, kind.b))
    found = rows.select("k1", "k2", "first", "q", "c").join(runs, ["q", "c"]).select("k1", "k2", (F.col("first") + F.col("at")).alias("first"), F.col("count").alias("n"))
    return found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "n")).alias("runs"))


def merged(runs: list[tuple[int, int]], w: int) -> list[tuple[int, int]]:
    """Disjoint covered intervals (start, end) of runs of windows, touching ones joined."""
    out: list[list[int]] = []
    for first, n in sorted(runs):
        end = first + n - 1 + w
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, z) for a, z in out]


def removal(docs: DataFrame, kind: Windows, find, kept: Callable[[str, list[tuple[int, int]]], tuple], schema: str, columns: list[str]) -> DataFrame:
    """``docs`` (with text) without its text, plus ``columns``: kept(text, covered intervals) of each row."""
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumns(dict(zip(("k1", "k2"), text_key(), strict=True)))
    found = materialize(repeated(keyed.select("k1", "k2", "text"), kind, find))
    w = kind.w

    @F.pandas_udf(schema)
    def result(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = [kept(t, merged([(int(x["first"]), int(x["n"])) for x in r], w) if r is not None else []) for t, r in zip(texts, runs, strict=True)]
        return pd.DataFrame(rows, columns=columns)

    x = keyed.join(found, ["k1", "k2"], "left").withColumn("r", result("text", "runs"))
    return x.select(*[c for c in docs.columns if c != "text"], "r.*")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
