"""Exact scores of vectors too long for floating point.

The metric trees hold vectors whose scaled squared norm stays under 2^52, so that floating point gives whole scores exactly. Pairs with a longer
vector are scored here: the stated queries against all longer vectors, and the longer ones among the queries against the others, block by
block. Scores are Python's whole numbers; where floating point can't overflow it first leaves out what is surely no result.

``key`` orders scores of any size as text. ``score`` is a long, so beyond 2^63 - 1 either way it stands at that bound; ranks follow the
exact values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, BLOCK, CHUNK = 256, 1024, 2048
MOST, SAFE = (1 << 63) - 1, 1e140
FOUND = "qk long, query_id long, vec_id long, score long, times long, key string"
TURNED = str.maketrans("0123456789", "9876543210")


def whole(x: float) -> int:
    """floor(256 x), exactly, also where 256 x is no double any more."""
    y = x * SCALE
    return math.floor(y) if math.isfinite(y) else int(x) * SCALE


def key_of(n: int) -> str:
    text = str(abs(n))
    text = f"{len(text):05d}{text}"
    return "1" + text if n >= 0 else "0" + text.translate(TURNED)


def key_column(score: Column) -> Column:
    """``key_of`` for scores that are longs."""
    digits = F.regexp_replace(score.cast("string"), "-", "")
    text = F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)
    return F.when(score >= 0, F.concat(F.lit("1"), text)).otherwise(F.concat(F.lit("0"), F.translate(text, "0123456789", "9876543210")))


def best_of(q: np.ndarray, held: np.ndarray, query_ids: np.ndarray, ids: list[np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """(query's place, vec_id, score) of each query's k best among the vectors; ids: of the equal rows of each vector."""
    exact_q, exact_c = ([[whole(x) for x in v] for v in m.tolist()] for m in (q, held))
    screen = np.ones((len(q), len(held)), bool)
    if len(held) > k + 1 and max(np.abs(q).max(initial=0), np.abs(held).max(initial=0)) < SAFE:
        a, b = np.floor(q * SCALE), np.floor(held * SCALE)
        near = a @ b.T
        error = 1 + 1e-9 * np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
        floor = np.partition(near - error, -(k + 1), axis=1)[:, -(k + 1)]  # one of k + 1 may be the query's own row
        screen = near + error >= floor[:, None]
    out = []
    for i, a in enumerate(exact_q):
        scored = []
        for j in np.flatnonzero(screen[i]).tolist():
            b = exact_c[j]
            rows = ids[j].tolist()
            if a == b and query_ids[i] in rows:
                rows.remove(query_ids[i])
            s = sum(x * y for x, y in zip(a, b, strict=True))
            scored += [(-s, r) for r in rows]
        out += [(i, r, -s) for s, r in sorted(scored)[:k]]
    return out


def scored(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best of each query and block of vectors, of pairs of which one is long: qk, query_id, vec_id, score, times, key.

    ``queries``: qk, query_id, x, times, long; ``vectors``: x, ids (the least ids of its rows), long. Vectors of unlike lengths aren't compared."""
    spark = queries.sparkSession
    n_q, n_v = queries.count(), vectors.count()
    parts_q, parts_v = max(1, -(-n_q // BLOCK)), max(1, -(-n_v // CHUNK))
    # odd numbers are blocks of long vectors
    block = (2 * F.pmod(F.xxhash64("qk"), F.lit(parts_q)) + F.col("long").cast("int")).cast("int")
    chunk = (2 * F.pmod(F.xxhash64("x"), F.lit(parts_v)) + F.col("long").cast("int")).cast("int")
    q = queries.withColumn("dim", F.size("x")).withColumn("block", block)
    v = vectors.withColumn("dim", F.size("x")).withColumn("chunk", chunk)
    blocks, chunks = (materialize(t.groupBy("dim", c).agg(F.count("*").alias("n")).drop("n")) for t, c in ((q, "block"), (v, "chunk")))
    tasks = materialize(blocks.join(chunks, "dim").where((F.col("block") % 2 == 1) | (F.col("chunk") % 2 == 1)))  # a row for each pair of blocks

    def answer(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(held):
            none = np.empty(0, object)
            return pd.DataFrame({"qk": [], "query_id": [], "vec_id": [], "score": [], "times": [], "key": none})
        dim = int(mine["dim"].iat[0])
        a, b = (np.array(list(m["x"]), float).reshape(len(m), dim) for m in (mine, held))
        found = best_of(a, b, mine["query_id"].to_numpy(), [np.asarray(i, np.int64) for i in held["ids"]], k)
        at = [i for i, _, _ in found]
        columns = {c: mine[c].to_numpy()[at] for c in ("qk", "query_id", "times")}
        return pd.DataFrame(columns | {"vec_id": [r for _, r, _ in found], "score": [max(-MOST, min(MOST, s)) for _, _, s in found], "key": np.array([key_of(s) for _, _, s in found], object)})[["qk", "query_id", "vec_id", "score", "times", "key"]]

    on = ["dim", "block", "chunk"]
    q, v = q.drop("long"), v.drop("long")
    asks, copies = q.join(tasks, ["dim", "block"]), v.join(tasks, ["dim", "chunk"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return asks.repartition(parts, *on).groupBy(*on).cogroup(copies.repartition(parts, *on).groupBy(*on)).applyInPandas(answer, FOUND)
