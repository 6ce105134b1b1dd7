"""A place cache on disk that is rewritten by the bucket and read as whole snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Stages
from .place_cache import SCHEMA, upsert

#: Side of the tiles whose coordinates share a bucket. A tile holds at most 250 x 250 coordinates of three decimals.
TILE_DEG = 0.25


def bucket_of(buckets: int) -> Column:
    """Bucket of a cache key. Neighbours share a tile, so addresses fetched for one region touch few buckets."""
    tile = [F.floor(F.col(c) / TILE_DEG) for c in ("lat3", "lng3")]
    return F.pmod(F.xxhash64(*tile), F.lit(buckets)).cast("int")


class PlaceStore:
    """Place cache as Parquet folders of buckets, copied on write.

    An upsert writes the buckets it touches anew, beside the old ones, and then a
    list that names the writing of every bucket. The list is the commit: a
    reader takes a complete list and with it a whole snapshot, whatever is
    written meanwhile; a failed upsert leaves folders that no list names, and its
    unfinished list is overwritten by the next. One job writes at a time, any number read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path, buckets

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists/*/_SUCCESS")
        done = found.getFileSystem(conf).globStatus(found) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done)

    def listed(self, version: int) -> DataFrame:
        """bucket, writing: which writing of a bucket belongs to a version; at most one row per bucket."""
        return self.spark.read.schema("bucket int, writing string").parquet(f"{self.path}/lists/version={version}")

    def read(self, version: int | None = None) -> DataFrame:
        """The cache as of a version, by default the latest. Other writings' folders are pruned."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, bucket int, writing string").parquet(f"{self.path}/rows")
        wanted = F.broadcast(self.listed(have[-1] if version is None else version))  # a row per bucket
        return rows.join(wanted, ["bucket", "writing"]).drop("bucket", "writing")

    def upsert(self, fresh: DataFrame) -> int:
        """Merge addresses, the latest per key wins; returns the new version.

        Keys with a null coordinate go to the bucket of null tiles like any other.
        """
        have, stage = self.versions(), Stages(self.spark)
        fresh = stage.save(fresh.select("lat3", "lng3", "zoom", "addr", "fetched_at"), "fresh")
        touched = stage.save(fresh.select(bucket_of(self.buckets).alias("bucket")).distinct(), "touched")
        merged = fresh
        if have:
            old = self.spark.read.schema(f"{SCHEMA}, bucket int, writing string").parquet(f"{self.path}/rows")
            wanted = self.listed(have[-1]).join(touched, "bucket", "left_semi")
            merged = old.join(F.broadcast(wanted), ["bucket", "writing"]).drop("bucket", "writing").unionByName(fresh)
        writing, version = uuid.uuid4().hex, (have[-1] if have else 0) + 1
        rows = upsert(merged.limit(0), merged).withColumns({"bucket": bucket_of(self.buckets), "writing": F.lit(writing)})
        rows.repartition("bucket").write.partitionBy("bucket", "writing").mode("append").parquet(f"{self.path}/rows")
        names = touched.withColumn("writing", F.lit(writing))
        if have:
            names = names.unionByName(self.listed(have[-1]).join(touched, "bucket", "left_anti"))
        names.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/version={version}")
        stage.remove()
        return version
