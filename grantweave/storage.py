"""Storing intermediate tables on the cluster's shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which all executors must share. A session on this machine alone (tests, bench) that
    lacks the setting gets a folder of its own; on a cluster its absence is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        import tempfile

        base = tempfile.mkdtemp(prefix="grantweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/grantweave-{uuid.uuid4().hex}"


def filesystem(path: str):
    """For tasks that read files themselves: a file system for a path or address, the path in it, and a function that lists a folder."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, at, lambda folder: sorted(x.path for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: loops keep short plans, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str, part: str | None = None) -> DataFrame:
    """All rows with their place ``out`` in an order, counted from 1 (within each value of ``part``, which then sorts first).

    Rows are cut into ranges of that order; a place is a row's number in its range plus the rows of the ranges before, so no task
    sorts them all. The counts are one row a range (and part)."""
    keys = [F.col(part)] if part else []
    ranges = stored(df.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id()))
    within = ["range", *([part] if part else [])]
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(*within).agg(F.count("*").alias("n")).select(*within, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    found = ranges.withColumn(out, place).join(F.broadcast(starts), within)
    return found.withColumn(out, (F.col(out) + F.col("start")).cast("long")).drop("range", "start")
