"""Search among vectors too long for floating point, against whole numbers."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantweave.llm import long_vectors, mtree


def component(x):
    y = 256 * x
    return math.floor(y) if math.isfinite(y) else 256 * int(x)


def expected(vectors):
    known = [(i, [component(x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for row, (q, v) in enumerate(known):
        if q is not None and q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c is None, c or 0) for other, (c, w) in enumerate(known) if other != row and len(w) == len(v))[:5]
            out.update((q, r + 1, None if none else c, max(-(2**63) + 1, min(2**63 - 1, -s))) for r, (s, none, c) in enumerate(best))
    return out


@pytest.mark.parametrize("size", [2e5, 3e5, 1e6, 1e17, 1e308])
def test_top_k_with_long_vectors(spark, size):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(120)]
    vectors += [(1000 + i, [rng.choice([-1, 1]) * size * rng.random() for _ in range(4)]) for i in range(40)]
    vectors += [(1050, [size, 0.0, 0.0, 0.0])] * 3 + [(2000, [size] * 4), (None, [size, 1.0, 0.0, 0.0]), (2050, [size, size]), (2051, [0.5, 0.5]), (2052, [float("inf"), 1.0]), (2053, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("key", F.lit("x")).repartition(3)
    assert Counter(tuple(r) for r in mtree.top_k(df).collect()) == expected(vectors)


def test_long_vectors_alone(spark, monkeypatch):
    monkeypatch.setattr(long_vectors, "BLOCK", 2)
    monkeypatch.setattr(long_vectors, "CHUNK", 16)
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1e9, 1e9) for _ in range(3)]) for i in range(0, 500, 5)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in mtree.top_k(df).collect()) == expected(vectors)


@given(st.lists(st.integers(-(10**30), 10**30), max_size=20))
def test_keys_sort_as_numbers(numbers):
    assert sorted(numbers) == sorted(numbers, key=long_vectors.key_of)


def test_key_column(spark):
    numbers = [0, 1, -1, 9, 10, -9, -10, 2**63 - 1, -(2**63) + 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", long_vectors.key_column(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in rows} == {n: long_vectors.key_of(n) for n in numbers}
