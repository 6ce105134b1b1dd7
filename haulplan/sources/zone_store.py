"""Zone state as parquet snapshots, one directory per version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.learning import STATE


class ZoneStore:
    """A new version is complete once its ``_SUCCESS`` marker exists.

    Readers take the newest complete version, so a failed write never leaves a
    half-written state behind.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = [int(n[2:]) for n in names if n.startswith("v=")]
        return sorted(v for v in found if self._fs.exists(self._path(f"{self.path}/v={v}/_SUCCESS")))

    def last_batch(self) -> int:
        return (self.versions() or [-1])[-1]

    def read(self) -> DataFrame:
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/v={done[-1]}")

    def write(self, state: DataFrame, version: int | None = None) -> None:
        version = self.last_batch() + 1 if version is None else version
        state.write.mode("overwrite").parquet(f"{self.path}/v={version}")
