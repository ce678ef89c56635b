"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session's Python workers receive at most ``rows`` texts at a time, so long texts don't fill their memory. Plans
    run later than they are made, so the setting stays; a smaller one is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(col: str = "text") -> list:
    """Two 64-bit hashes that stand for a text, the same wherever the text is read; null counts as empty."""
    t = F.coalesce(F.col(col), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by ``keys``, cut again so that each group is whole; a group lies in one frame."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        changes = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(changes):
            cut = int(changes[-1])
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True)
            held = [b.iloc[cut:]]
        else:
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)
