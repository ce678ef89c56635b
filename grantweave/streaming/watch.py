"""Keeping configuration state current from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import shared_path


def upsert(state: DataFrame | None, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The state with each key's last change; a change whose ``deleted`` is true removes its key."""
    last = changes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("r = 1").drop("r")
    if state is None:
        return last.where("NOT deleted")
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("NOT deleted"))


class Watcher:
    """Micro-batches of changed files folded into a state table.

    Each batch writes the version of its number from the newest version before it, so a retried batch gives the same result and a
    restarted stream goes on from what it left; the version before last is then dropped. Triggers bundle changes that arrive close together.
    """

    def __init__(self, spark: SparkSession, key: str, order: str, path: str | None = None):
        self.spark, self.key, self.order, self.path = spark, key, order, path or shared_path(spark)

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self) -> list[int]:
        """Numbers of the versions that are complete, in order."""
        fs, root = self._files()
        if not fs.exists(root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n and fs.exists(path(f"{self.path}/versions/{n}/_SUCCESS")))

    def _at(self, version: int) -> str:
        return f"{self.path}/versions/version={version}"

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        before = [v for v in self.versions() if v < batch_id]
        state = self.spark.read.parquet(self._at(before[-1])) if before else None
        upsert(state, batch, self.key, self.order).write.mode("overwrite").parquet(self._at(batch_id))
        fs, _ = self._files()
        for old in before[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._at(old)), True)

    def start(self, stream: DataFrame, seconds: int | None = None) -> StreamingQuery:
        """Runs until all present files are taken in, or every ``seconds``."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/progress")
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()

    def state(self) -> DataFrame:
        return self.spark.read.parquet(self._at(self.versions()[-1]))
