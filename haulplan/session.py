"""Session defaults and stage tables."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "haulplan", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, as in tests, may do without the setting; it then
    gets a temporary folder. On a cluster a machine-local folder would be lost
    with its executor, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has machines of its own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _local_folders:
        _local_folders[sc.applicationId] = tempfile.mkdtemp(prefix="haulplan-")
        sc.setCheckpointDir(_local_folders[sc.applicationId])
    return _local_folders[sc.applicationId]


def spread(df: DataFrame, *keys) -> DataFrame:
    """Partition by ``keys`` for a Python step.

    Adaptive execution sizes partitions by bytes and would put a small but
    CPU-heavy input into one task; a partition count of our own keeps the
    tasks apart. A groupBy on the same keys needs no further shuffle.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys)


#: Bytes of a stage table from which a collection of the driver's garbage is worth its second.
LARGE_STAGE = 16 << 20


class Stages:
    """Writes stage results as parquet tables in the shared folder.

    A stage table cuts the lineage: a lost executor re-reads it instead of
    recomputing the run, and later stages scan only the columns they need.
    """

    def __init__(self, spark: SparkSession, run: str | None = None, compression: str | None = None):
        self.spark = spark
        self.root = os.path.join(shared_folder(spark), "haulplan", run or uuid.uuid4().hex)
        self.compression = compression

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=self.compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self, written: str, *gone: str) -> None:
        """The step that wrote ``written`` is over: tables that no later step reads go, and where it is large, the shuffle files of the jobs so far."""
        size = self._files().getContentSummary(self._path(written)).getLength()
        for name in gone:
            self._files().delete(self._path(name), True)
        if size > LARGE_STAGE:
            self.release()

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, name).rstrip("/"))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def release(self) -> None:
        """Let the shuffle files of finished jobs go: Spark drops them with the driver's garbage, which a quiet driver collects rarely."""
        for _ in range(2):  # the first round frees what holds the plans, the second the shuffles
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def remove(self) -> None:
        """Delete the run's stage tables, once nothing reads them any more."""
        self._files().delete(self._path(), True)
