"""Queries over a place cache that Spark derives from the shipments, with their SQL.

Every pickup point of the shipments is a cache key; a number made of its
coordinates decides zoom, address (missing, blank first field, or a town) and age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.places import address_name, assign_places, cache_key
from ..session import Stages
from ..sources import place_cache
from ..sources.place_store import PlaceStore
from ..sources.shipments import shipments_view
from .oracles import SHIP, big, bucket, city


def _points(spark, sf) -> DataFrame:
    view = shipments_view(spark, sf)
    points = view.select(cache_key(F.col("pickup_lat")).alias("lat3"), cache_key(F.col("pickup_lng")).alias("lng3")).distinct()
    mark = F.round(F.col("lat3") * 1000).cast("long") * 7 + F.round(F.col("lng3") * 1000).cast("long")
    return points.withColumn("m", mark)


def derived_cache(spark, sf) -> DataFrame:
    m = F.col("m")
    named = lambda field, letter, k: F.create_map(F.lit(field), F.concat(F.lit(letter), (m % k).cast("string")))
    blank = F.map_concat(F.create_map(F.lit("city"), F.lit(" ")), named("county", "C", 97))
    addr = F.when(m % 5 == 0, F.create_map().cast("map<string,string>")).when(m % 5 == 1, blank).otherwise(named("town", "T", 97))
    return _points(spark, sf).select(
        "lat3", "lng3", F.when(m % 3 == 0, 8).otherwise(10).alias("zoom"), addr.alias("addr"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("fetched_at"),
    )


def derived_fetch(spark, sf) -> DataFrame:
    """Addresses fetched for a quarter of the keys, half of them before the cache's own."""
    m = F.col("m")
    at = F.when(m % 8 == 0, F.lit("2024-02-01 00:00:00")).otherwise(F.lit("2023-12-01 00:00:00"))
    addr = F.create_map(F.lit("city"), F.concat(F.lit("N"), (m % 89).cast("string")))
    return _points(spark, sf).filter(m % 4 == 0).select(
        "lat3", "lng3", F.when(m % 3 == 0, 8).otherwise(10).alias("zoom"), addr.alias("addr"), F.to_timestamp(at).alias("fetched_at")
    )


def _thousandth(c: str):
    return F.round(F.col(c) * 1000).cast("long").alias(c.replace("3", "_m"))


def place_cache_stats(spark, sf):
    return place_cache.cache_stats(derived_cache(spark, sf))


def place_cache_eviction(spark, sf):
    kept, removed = place_cache.evict_empty(derived_cache(spark, sf))
    return kept.agg(F.count("*").alias("kept")).crossJoin(removed)  # one row each


def place_cache_upsert(spark, sf):
    merged = place_cache.upsert(derived_cache(spark, sf), derived_fetch(spark, sf))
    return merged.select(_thousandth("lat3"), _thousandth("lng3"), "zoom", address_name(F.col("addr")).alias("name"))


def _store(spark, sf) -> PlaceStore:
    """A store of two versions: the cache, then the fetched addresses."""
    store = PlaceStore(spark, f"{Stages(spark).root}/places")
    store.upsert(derived_cache(spark, sf))
    store.upsert(derived_fetch(spark, sf))
    return store


def _entries(cache: DataFrame) -> DataFrame:
    return cache.select(_thousandth("lat3"), _thousandth("lng3"), "zoom", address_name(F.col("addr")).alias("name"))


def place_store_latest(spark, sf):
    return _entries(_store(spark, sf).read())


def place_store_snapshot(spark, sf):
    """The first version, read after the second was written."""
    return _entries(_store(spark, sf).read(1))


def place_cache_warm_up(spark, sf):
    return place_cache.warm_up_counts(shipments_view(spark, sf), derived_cache(spark, sf))


def cached_places(spark, sf):
    return assign_places(shipments_view(spark, sf), derived_cache(spark, sf)).select(
        "shipment_id", "pickup_place", "pickup_source", "delivery_place", "delivery_source", "degraded_place"
    )


QUERIES = {
    "place_cache_stats": place_cache_stats,
    "place_cache_eviction": place_cache_eviction,
    "place_cache_upsert": place_cache_upsert,
    "place_store_latest": place_store_latest,
    "place_store_snapshot": place_store_snapshot,
    "place_cache_warm_up": place_cache_warm_up,
    "cached_places": cached_places,
}

_M = lambda c: big(f"round({c} * 1000)")
_CACHE = f"""points AS (SELECT DISTINCT {_M('pickup_lat')} AS lat_m, {_M('pickup_lng')} AS lng_m FROM ship),
cache AS (SELECT lat_m, lng_m, m, CASE WHEN m % 3 = 0 THEN 8 ELSE 10 END AS zoom, CASE WHEN m % 5 = 0 THEN NULL WHEN m % 5 = 1 THEN 'C' || CAST(m % 97 AS VARCHAR) ELSE 'T' || CAST(m % 97 AS VARCHAR) END AS name
 FROM (SELECT *, lat_m * 7 + lng_m AS m FROM points))"""


def _place(side: str) -> str:
    lat, lng = f"{side}_lat", f"{side}_lng"
    return (
        f"coalesce({side[0]}.name, {city(lat, lng)}, {bucket(lat, lng)}) AS {side}_place, CASE WHEN {side[0]}.name IS NOT NULL THEN 'zoom' || CAST({side[0]}.zoom AS VARCHAR) "
        f"WHEN {city(lat, lng)} IS NOT NULL THEN 'city' ELSE 'bucket' END AS {side}_source"
    )


ORACLES = {
    "place_cache_stats": f"""WITH {SHIP}, {_CACHE} SELECT count(*) AS total, count(name) AS populated, count(*) - count(name) AS empty, count(*) FILTER (zoom = 10) AS zoom_10, count(*) FILTER (zoom = 8) AS zoom_8 FROM cache""",
    "place_cache_eviction": f"WITH {SHIP}, {_CACHE} SELECT count(name) AS kept, count(*) - count(name) AS removed FROM cache",
    "place_cache_upsert": f"WITH {SHIP}, {_CACHE} SELECT lat_m, lng_m, zoom, CASE WHEN m % 8 = 0 THEN 'N' || CAST(m % 89 AS VARCHAR) ELSE name END AS name FROM cache",
    "place_store_latest": f"WITH {SHIP}, {_CACHE} SELECT lat_m, lng_m, zoom, CASE WHEN m % 8 = 0 THEN 'N' || CAST(m % 89 AS VARCHAR) ELSE name END AS name FROM cache",
    "place_store_snapshot": f"WITH {SHIP}, {_CACHE} SELECT lat_m, lng_m, zoom, name FROM cache",
    "place_cache_warm_up": f"""WITH {SHIP}, {_CACHE}, ends AS (SELECT pickup_lat AS lat, pickup_lng AS lng FROM ship UNION SELECT delivery_lat, delivery_lng FROM ship),
hit AS (SELECT e.lat, EXISTS (SELECT 1 FROM cache c WHERE c.zoom = 10 AND c.lat_m = {_M('e.lat')} AND c.lng_m = {_M('e.lng')}) AS known FROM ends e)
SELECT count(*) AS unique_points, count(*) FILTER (known) AS already_cached, count(*) FILTER (NOT known) AS to_fetch, CAST(0 AS BIGINT) AS skipped_invalid FROM hit""",
    "cached_places": f"""WITH {SHIP}, {_CACHE}, named AS (SELECT shipment_id, {_place('pickup')}, {_place('delivery')} FROM ship
 LEFT JOIN cache p ON p.lat_m = {_M('pickup_lat')} AND p.lng_m = {_M('pickup_lng')} LEFT JOIN cache d ON d.lat_m = {_M('delivery_lat')} AND d.lng_m = {_M('delivery_lng')})
SELECT *, pickup_source = 'bucket' OR delivery_source = 'bucket' AS degraded_place FROM named""",
}
