"""Topics of texts by k-means over hashed word vectors, fitted in Spark on all rows.

A text's vector has ``WIDTH`` places; each different word of ``LONG`` or more bytes adds or takes one at the place its hash
names, and the vector is scaled to length ``UNIT`` in whole numbers, so sums are exact in any order. The mean
vector of the row's language is taken off first (of languages with at least 1 / ``GROUPS`` of the rows; others
share the mean of all), since topics should not be languages again. Starting centres are picked farthest first among about
``SEEDS`` rows with small hashes; ``STEPS`` rounds of assignment and averaging follow, each one aggregate of
TOPICS * WIDTH sums. A text without such words has topic -1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPICS, WIDTH, LONG, UNIT, GROUPS, SEEDS, STEPS = 8, 64, 5, 1000, 256, 512, 6


class Places(dict):
    """Word -> place and sign, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        place = xxhash.xxh32_intdigest(word) % (2 * WIDTH) if len(word) >= LONG else 2 * WIDTH
        if len(word) <= 32:
            self[word] = place
        return place


PLACES = Places()


def vector_of(text: str) -> bytes | None:
    words = set(text.lower().encode("utf-8", "replace").split())
    n = np.bincount(np.fromiter(map(PLACES.__getitem__, words), np.int64, len(words)), minlength=2 * WIDTH + 1)
    v = (n[:WIDTH] - n[WIDTH : 2 * WIDTH]).astype(float)
    size = np.sqrt(v @ v)
    return np.rint(v * (UNIT / size)).astype(np.int16).tobytes() if size else None


@F.pandas_udf(T.BinaryType())
def vectors(texts: pd.Series) -> pd.Series:
    return pd.Series([vector_of(t) for t in texts.fillna("")], dtype=object)


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int16).reshape(-1, WIDTH).astype(np.int64)


def sums(rows: DataFrame, grouped: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], key: str) -> dict:
    """The mean of each group in whole numbers; ``grouped`` gives the keys and the vectors of a frame's rows."""

    def add(batches):
        held: dict = {}
        for b in batches:
            if len(b):
                keys, v = grouped(b)
                for k, at in pd.Series(keys).groupby(np.asarray(keys)).indices.items():
                    s, n = held.get(k, (0, 0))
                    held[k] = s + v[at].sum(axis=0), n + len(at)
        for k, (s, n) in held.items():
            yield pd.DataFrame({"key": k, "place": np.arange(WIDTH, dtype=np.int32), "s": s, "n": n})

    found = rows.mapInPandas(add, f"key {key}, place int, s long, n long").groupBy("key", "place").agg((F.sum("s") / F.sum("n")).alias("mean"))
    out: dict = {}
    for r in found.collect():  # WIDTH numbers a group
        out.setdefault(r.key, np.zeros(WIDTH, np.int64))[r.place] = round(r.mean)
    return out


def centred(b: pd.DataFrame, mean: dict) -> np.ndarray:
    return matrix(b["v"]) - np.stack([mean.get(k, mean[""]) for k in b["lang"]])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, ties to the first."""
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def fit(rows: DataFrame) -> tuple[dict, np.ndarray] | None:
    """(mean vectors by language, "" for the others; centres) of stored rows (lang, v); None without any vector."""
    spoken = rows.where("v IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), "v")
    n = spoken.count()
    if not n:
        return None
    own = {r.lang for r in spoken.groupBy("lang").count().where(F.col("count") * GROUPS >= n).collect()}  # GROUPS rows at most
    mean = sums(spoken, lambda b: (b["lang"].where(b["lang"].isin(own), "").to_numpy(), matrix(b["v"])), "string")
    mean.setdefault("", np.zeros(WIDTH, np.int64))
    u = F.shiftrightunsigned(F.xxhash64("v"), 11) / F.lit(float(1 << 53))
    picked = spoken.where(u < (SEEDS + 8 * SEEDS**0.5 + 16) / n).distinct().orderBy("v", "lang").toPandas()  # about SEEDS rows
    seeds = centred(picked, mean) if len(picked) else np.zeros((1, WIDTH), np.int64)
    chosen, far = [0], np.full(len(seeds), np.inf)
    while len(chosen) < min(TOPICS, len(seeds)):
        far = np.minimum(far, ((seeds - seeds[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    centres = seeds[chosen]
    for _ in range(STEPS):

        def step(b: pd.DataFrame, centres=centres) -> tuple[np.ndarray, np.ndarray]:
            x = centred(b, mean)
            return nearest(x, centres), x

        now = sums(spoken, step, "long")
        centres = np.stack([now.get(i, c) for i, c in enumerate(centres)])
    return mean, centres


def with_topics(rows: DataFrame) -> DataFrame:
    """Stored rows (lang, v, ...) with ``topic`` in place of ``v``."""
    model = fit(rows)

    @F.pandas_udf("int")
    def topic(lang: pd.Series, v: pd.Series) -> pd.Series:
        out, some = pd.Series(-1, index=v.index, dtype="int32"), v.notna()
        if model and some.any():
            b = pd.DataFrame({"lang": lang[some].fillna(""), "v": v[some]})
            out[some] = nearest(centred(b, model[0]), model[1]).astype(np.int32)
        return out

    return rows.withColumn("topic", topic("lang", "v")).drop("v")
