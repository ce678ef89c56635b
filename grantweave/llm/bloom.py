"""Bloom filters sized by the number of their keys, to leave out most rows that a later exact join would drop.

A filter never loses a row; beyond its largest size it only lets more rows through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 20, 1 << 28


def sized(keys: int) -> int:
    """Bits for a number of keys: 16 a key or a little more, a power of two."""
    return min(MOST, max(LEAST, 1 << (16 * keys).bit_length()))


def slots_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.asarray(keys).view(np.uint64)
    return k & np.uint64(bits - 1), (k >> np.uint64(32)) & np.uint64(bits - 1)


def bloom(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of the given bits: each task sends the part of it that its key range covers, bits / 8 bytes in all."""
    slots = keys.select(F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1))).alias("x")).distinct()
    part = slots.select((F.col("x") / (1 << 20)).cast("int").alias("p"), F.col("x").bitwiseAND((1 << 20) - 1).cast("int").alias("x"))

    def fold(batches):
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for p, rows in b.groupby("p"):
                seen.setdefault(p, np.zeros(1 << 20, np.uint8))[rows["x"].to_numpy()] = 1
        yield pd.DataFrame({"p": list(seen), "bits": [np.packbits(v).tobytes() for v in seen.values()]})

    full = np.zeros(bits // 8, np.uint8)
    for row in part.repartition(max(1, bits >> 22), "p").mapInPandas(fold, "p int, bits binary").toLocalIterator():
        full[row.p << 17 : (row.p + 1) << 17] |= np.frombuffer(row.bits, np.uint8)
    return full


def in_bloom(full: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for slot in slots_of(keys, 8 * len(full)):
        hit &= (full[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return hit
