"""Place cache as a table: lat3, lng3, zoom, addr MAP, fetched_at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.places import cache_key
from ..operators.validate import coord_error

SCHEMA = "lat3 double, lng3 double, zoom int, addr map<string,string>, fetched_at timestamp"


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge new addresses into the cache; the latest per key wins.

    ``max_by`` combines on the map side, so a key fetched very often never
    gathers in one task.
    """
    return (
        cache.select("lat3", "lng3", "zoom", "addr", "fetched_at")
        .unionByName(fresh.select("lat3", "lng3", "zoom", "addr", "fetched_at"))
        .groupBy("lat3", "lng3", "zoom")
        .agg(F.max_by("addr", "fetched_at").alias("addr"), F.max("fetched_at").alias("fetched_at"))
    )


def evict_empty(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with an address, one-row count of the empty ones)."""
    full = F.coalesce(F.size("addr"), F.lit(0)) > 0
    return cache.filter(full), cache.filter(~full).agg(F.count("*").alias("removed"))


def cache_stats(cache: DataFrame) -> DataFrame:
    full = F.coalesce(F.size("addr"), F.lit(0)) > 0
    return cache.agg(
        F.count("*").alias("total"),
        F.count_if(full).alias("populated"),
        F.count_if(~full).alias("empty"),
        F.count_if(F.col("zoom") == 10).alias("zoom_10"),
        F.count_if(F.col("zoom") == 8).alias("zoom_8"),
    )


def distinct_points(shipments: DataFrame) -> DataFrame:
    pick = shipments.select(F.col("pickup_lat").alias("lat"), F.col("pickup_lng").alias("lng"))
    drop = shipments.select(F.col("delivery_lat").alias("lat"), F.col("delivery_lng").alias("lng"))
    return pick.union(drop).distinct()


def missing_points(shipments: DataFrame, cache: DataFrame) -> DataFrame:
    """Valid distinct points without a zoom-10 entry: what still has to be fetched."""
    keys = cache.filter("zoom = 10").select("lat3", "lng3").distinct()
    return (
        distinct_points(shipments)
        .filter(coord_error("lat", "lng").isNull())
        .withColumns({"lat3": cache_key(F.col("lat")), "lng3": cache_key(F.col("lng"))})
        .join(keys, ["lat3", "lng3"], "left_anti")
    )


def warm_up_counts(shipments: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct points by state: cached, to fetch, invalid."""
    keys = cache.filter("zoom = 10").select("lat3", "lng3", F.lit(True).alias("hit")).distinct()
    pts = (
        distinct_points(shipments)
        .withColumn("bad", coord_error("lat", "lng").isNotNull())
        .withColumns({"lat3": cache_key(F.col("lat")), "lng3": cache_key(F.col("lng"))})
        .join(keys, ["lat3", "lng3"], "left")
    )
    return pts.agg(
        F.count("*").alias("unique_points"),
        F.count_if(~F.col("bad") & F.col("hit").isNotNull()).alias("already_cached"),
        F.count_if(~F.col("bad") & F.col("hit").isNull()).alias("to_fetch"),
        F.count_if("bad").alias("skipped_invalid"),
    )
