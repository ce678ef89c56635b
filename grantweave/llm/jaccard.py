"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A text is the set of its five-word shingles (a shorter text that has words is one shingle). Band and row counts
are the cheapest that reach ``RECALL`` at the threshold. Equal texts form one class at once, known by two 64-bit
hashes, and only one of each takes part in what follows.

1. Texts shuffle on their band hashes; buckets with one class end there. A bucket of n classes is cut into blocks
   of ``BLOCK`` classes and its pairs of blocks become tasks, so no task holds more than two blocks however hot
   the bucket is.
2. A pair belongs to the first band in which it agrees. A task keeps the members that own a pair in it; only their
   texts are fetched, others being left out by a Bloom filter before the exact join.
3. The task computes the shared shingles of all its pairs at once and returns, per text, the number of its links
   and, per connected part, a star of links: never all pairs.
4. Stars meet in connected components by least labels and pointer jumping, stored after each round.

Result: one row per document with the class of its component (its least doc_id) and the number of other texts it
is linked to. A null text counts as empty; empty texts have no shingles and no links but are equal to each other.
Null ids and repeated rows keep a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, in_bloom, sized
from .common import materialize, small_batches, text_key, whole_groups
from .words import gram_hashes, mixed, word_hashes, words_of

SHINGLE, THRESHOLD, RECALL, HASHES, BLOCK = 5, 0.8, 0.9999, 128, 256


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall within ``most`` hashes; more rows mean fewer false candidates."""
    best = None
    for rows in range(1, 20):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("the recall can't be reached with so few hashes")
    return best


def shingles(text: str) -> np.ndarray:
    """The set, sorted."""
    w = word_hashes(words_of(text))
    return np.unique(gram_hashes(w, min(SHINGLE, len(w)))) if len(w) else np.empty(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_hashes(sets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band, different bands never sharing one but by chance."""
    a = multipliers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 512):
        least = np.minimum(least, (sets[at : at + 512, None] * a[None, :]).min(axis=0))
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for part in mixed(least).reshape(bands, rows).T:
        h = mixed(h * np.uint64(31) + part)
    return h.view(np.int64)


def groups_in(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    k = frame[keys].to_numpy()
    edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
    yield from zip(edges[:-1], edges[1:], strict=True)


TASK = ["h", "i", "j"]
NODE = ["k1", "k2"]


def owned(bands: np.ndarray, h: int, side: np.ndarray, i: int, j: int) -> np.ndarray:
    """Pairs (a < b) of a task that agree first in the band whose hash is ``h``; across blocks if i differs from j."""
    band = int(np.argmax(bands[0] == h))
    pairs = np.triu(np.ones((len(bands), len(bands)), bool), 1)
    if i != j:
        pairs &= side[:, None] != side[None, :]
    for b in range(band):
        pairs &= bands[:, b][:, None] != bands[:, b][None, :]
    return pairs


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence blocks."""
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.zeros((len(sets), len(sets)))
    width = 1 << 13
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (low, low + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], place[a:b] - low] = 1
        shared += m @ m.T
    return shared


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(k1, k2, r1, r2): every node that has a link with the least node of its component. ``links``: (a1, a2, b1, b2), each once."""
    links = materialize(links.union(links.select("b1", "b2", "a1", "a2")).distinct())
    pair = lambda a, b: F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))
    label = materialize(links.groupBy(pair("a1", "a2").alias("v")).agg(F.min(pair("b1", "b2")).alias("m")).select("v", F.least("v", "m").alias("l")))
    while True:
        near = links.select(pair("a1", "a2").alias("v"), pair("b1", "b2").alias("w")).join(label.select(F.col("v").alias("w"), "l"), "w").groupBy("v").agg(F.min("l").alias("n"))
        step = label.join(near, "v").select("v", F.col("l").alias("was"), F.least("l", "n").alias("l"))
        jump = label.select(F.col("v").alias("l"), F.col("l").alias("up"))
        new = materialize(step.join(jump, "l", "left").select("v", "was", F.least("l", F.coalesce("up", "l")).alias("l")))
        changed = new.where(F.col("was") != F.col("l")).limit(1).count()
        label = new.drop("was")
        if not changed:
            return label.select("v.k1", "v.k2", F.col("l.k1").alias("r1"), F.col("l.k2").alias("r2"))


def linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(links per text (k1, k2, n_links), star links (a1, a2, b1, b2)) of a table (k1, k2, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = bands_for(threshold, recall)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("array<bigint>")
    def signature(texts: pd.Series) -> pd.Series:
        sets = (shingles(t) for t in texts)
        return pd.Series([band_hashes(s, bands, rows) if len(s) else np.empty(0, np.int64) for s in sets], dtype=object)

    signed = docs.select(*NODE, signature("text").alias("bands")).where(F.size("bands") > 0)
    texts = materialize(signed.groupBy(*NODE).agg(F.first("bands").alias("bands")))
    member = texts.select(*NODE, F.explode("bands").alias("h"))
    full = member.groupBy("h").count().where("count > 1").select("h", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    member = member.join(full, "h").withColumn("own", F.pmod(F.xxhash64("k2", "k1"), F.col("blocks")).cast("int"))
    # with block number o of n, a member takes part in the tasks (min(o, x), max(o, x)) for every block x
    tasks = member.select("h", *NODE, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")).select(
        "h", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", *NODE
    )
    tasks = tasks.join(texts, NODE).repartition(parts, *TASK).sortWithinPartitions(*TASK, *NODE)

    def active(batches):
        for frame in whole_groups(batches, TASK):
            bh, keep = np.stack(frame["bands"].to_numpy()), np.zeros(len(frame), bool)
            for a, b in groups_in(frame, TASK):
                if b - a > 1:
                    pairs = owned(bh[a:b], frame["h"].iat[a], frame["own"].to_numpy()[a:b], frame["i"].iat[a], frame["j"].iat[a])
                    keep[a:b] = pairs.any(axis=0) | pairs.any(axis=1)
            yield frame.loc[keep, [*TASK, "own", *NODE]]

    held = materialize(tasks.mapInPandas(active, "h long, i int, j int, own int, k1 long, k2 long"))
    wanted = materialize(held.select(*NODE).distinct())
    filters = spark.sparkContext.broadcast(bloom(wanted, "k1", sized(wanted.count())))  # 32 MB at most; most texts are left out before they shuffle

    @F.pandas_udf("boolean")
    def likely(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(filters.value, keys.to_numpy(np.int64)))

    fetched = docs.where(likely("k1")).join(wanted, NODE, "left_semi").dropDuplicates(NODE)
    ready = held.join(fetched, NODE).repartition(parts, *TASK).sortWithinPartitions(*TASK, *NODE)

    def verify(batches):
        for frame in whole_groups(batches, TASK):
            k, own = frame[NODE].to_numpy(), frame["own"].to_numpy()
            out: list[tuple] = []
            for a, b in groups_in(frame, TASK):
                sets = [shingles(t) for t in frame["text"].iloc[a:b]]
                bh = np.stack([band_hashes(s, bands, rows) for s in sets])
                size = np.array([len(s) for s in sets], float)
                shared = intersections(sets)
                link = owned(bh, frame["h"].iat[a], own[a:b], frame["i"].iat[a], frame["j"].iat[a])
                link &= shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                counts = link.sum(axis=0) + link.sum(axis=1)
                root = np.arange(b - a)
                for x, y in zip(*np.nonzero(link), strict=True):
                    rx, ry = root[x], root[y]
                    if rx != ry:
                        root[root == max(rx, ry)] = min(rx, ry)
                out += [(*k[a + x], int(counts[x]), *k[a + root[x]]) for x in range(b - a) if counts[x]]
            yield pd.DataFrame(out, columns=["k1", "k2", "n", "r1", "r2"])

    found = materialize(ready.mapInPandas(verify, "k1 long, k2 long, n long, r1 long, r2 long"))
    stars = found.where("k1 != r1 OR k2 != r2").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("r1").alias("b1"), F.col("r2").alias("b2")).distinct()
    return found.groupBy(*NODE).agg(F.sum("n").alias("n_links")), stars


def labelled(docs: DataFrame, key: list, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links per text, root per linked text) for a table with a text column."""
    texts = docs.select(*key, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n_links, stars = linked(texts, threshold)
    return n_links, components(n_links, stars)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n_links, roots = labelled(docs, text_key())
    x = docs.select("doc_id", *text_key()).join(roots, NODE, "left").join(n_links, NODE, "left")
    x = materialize(x.select("doc_id", F.coalesce("r1", "k1").alias("r1"), F.coalesce("r2", "k2").alias("r2"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    least = x.groupBy("r1", "r2").agg(F.min("doc_id").alias("class_id"))
    return x.join(least, ["r1", "r2"]).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least doc_id (nulls last), with its own columns."""
    _, roots = labelled(docs, text_key(), threshold)
    d = F.col("row.doc_id")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *text_key())
    plain = "map<" not in keyed.schema["row"].dataType.simpleString()  # maps have no hash of their own
    keyed = keyed.withColumns({"a": d.isNull(), "b": F.coalesce(d.cast("long"), F.lit(0).cast("long")), "c": F.xxhash64("row" if plain else F.to_json("row"))})
    # which row stays is settled on keys alone; whole rows then shuffle once, on keys that only repeated rows share
    key = ["a", "b", "c", *NODE]
    x = keyed.select(*key).join(roots, NODE, "left").select(F.struct(*key).alias("o"), F.coalesce("r1", "k1").alias("r1"), F.coalesce("r2", "k2").alias("r2"))
    best = x.groupBy("r1", "r2").agg(F.min("o").alias("o")).select("o.*")
    return keyed.join(best.hint("merge"), key).dropDuplicates(key).select("row.*")


def sql(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same result by joining all shingles, in DuckDB's SQL."""
    return rf"""WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS least, row_number() OVER (ORDER BY coalesce(text, '')) AS k FROM {table} GROUP BY coalesce(text, '')),
w AS (SELECT k, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM t),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c >= {threshold} * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(k, m) AS (SELECT k, k FROM t UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.m),
m AS (SELECT r.k, min(t.least) AS class_id FROM r JOIN t ON t.k = r.m GROUP BY r.k),
d AS (SELECT a AS k, count(*) AS n_links FROM e GROUP BY a)
SELECT x.doc_id, m.class_id, coalesce(d.n_links, 0)::BIGINT AS n_links FROM {table} x JOIN t ON t.text = coalesce(x.text, '') JOIN m ON m.k = t.k LEFT JOIN d ON d.k = t.k"""
