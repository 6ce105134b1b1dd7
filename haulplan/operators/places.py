"""Place names for coordinates: cached address, city box, grid bucket."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .validate import coord_error

# Address fields, most specific first.
ADDRESS_FIELDS = (
    "industrial", "suburb", "neighbourhood", "city_district", "town",
    "city", "district", "state_district", "county", "state",
)

# Fixed values: (city, lat min, lat max, lng min, lng max); the first hit counts.
CITY_BOXES = (
    ("Bhiwandi", 19.25, 19.40, 73.00, 73.12),
    ("Thane", 19.12, 19.26, 72.95, 73.05),
    ("Kalyan-Dombivli", 19.20, 19.29, 73.10, 73.22),
    ("Mumbai", 18.85, 19.20, 72.70, 73.00),
    ("Navi Mumbai", 18.95, 19.12, 73.00, 73.10),
    ("Raigad", 18.82, 19.00, 73.05, 73.28),
    ("Pimpri-Chinchwad", 18.60, 18.70, 73.75, 73.90),
    ("Pune", 18.40, 18.65, 73.68, 74.05),
    ("Nashik", 19.90, 20.10, 73.60, 73.95),
    ("Surat", 21.00, 21.35, 72.70, 73.05),
    ("Vadodara", 22.20, 22.55, 73.08, 73.35),
    ("Ahmedabad", 22.90, 23.22, 72.40, 72.82),
    ("Hyderabad", 17.20, 17.65, 78.18, 78.75),
    ("Bengaluru", 12.80, 13.10, 77.40, 77.82),
    ("Chennai", 12.70, 13.40, 79.78, 80.52),
    ("Kolkata", 22.38, 22.72, 88.18, 88.52),
    ("Delhi", 28.38, 28.92, 76.78, 77.42),
    ("Kanpur", 26.28, 26.62, 80.18, 80.52),
    ("Hubballi", 15.18, 15.52, 74.98, 75.32),
    ("Kolhapur", 16.58, 16.82, 74.08, 74.32),
    ("Dharwad", 15.38, 15.52, 75.00, 75.18),
    ("Nagpur", 21.05, 21.25, 79.00, 79.22),
    ("Bally", 22.58, 22.72, 88.28, 88.42),
    ("Bidhannagar", 22.55, 22.65, 88.38, 88.52),
)


def address_name(addr: Column) -> Column:
    """First non-blank of the ten address fields, null when there is none."""
    return F.coalesce(*[F.nullif(F.trim(addr[f]), F.lit("")) for f in ADDRESS_FIELDS])


CELLS_PER_DEG = 2


def _cell(lat: str, lng: str) -> Column:
    return F.expr(
        f"CAST(floor({lat} * {CELLS_PER_DEG}) AS INT) * 10000 + CAST(floor({lng} * {CELLS_PER_DEG}) AS INT)"
    )


def city_cells(spark: SparkSession) -> DataFrame:
    """City boxes by half-degree cell: about fifty rows, whatever the data."""
    cells: dict[int, list] = {}
    for city, *box in CITY_BOXES:
        a, b, c, d = (math.floor(v * CELLS_PER_DEG) for v in box)
        for i in range(a, b + 1):
            for j in range(c, d + 1):
                cells.setdefault(i * 10000 + j, []).append((city, *box))
    return spark.createDataFrame(
        list(cells.items()),
        "city_cell int, boxes array<struct<city: string, a: double, b: double, c: double, d: double>>",
    )


def with_city(df: DataFrame, lat: str, lng: str, out: str) -> DataFrame:
    """Add the first city whose box holds the point, through its grid cell.

    The cell table has a fixed size, so it is broadcast.
    """
    cells = F.broadcast(city_cells(df.sparkSession))
    hit = F.expr(
        f"filter(boxes, x -> {lat} >= x.a AND {lat} <= x.b AND {lng} >= x.c AND {lng} <= x.d)"
    )
    return (
        df.withColumn("city_cell", _cell(lat, lng))
        .join(cells, "city_cell", "left")
        .withColumn(out, F.try_element_at(hit, F.lit(1))["city"])
        .drop("city_cell", "boxes")
    )


def bucket_name(lat: str, lng: str) -> Column:
    """Name of the 0.2 degree cell, rounding halves to even."""
    step = f"{K.BUCKET_DEG}D"
    return F.expr(f"format_string('%.1f_%.1f', rint({lat} / {step}) * {step}, rint({lng} / {step}) * {step})")


def cache_key(c: Column) -> Column:
    return F.round(c, K.COORD_DECIMALS)


def cache_names(cache: DataFrame) -> DataFrame:
    """Cache in lookup form: one row per key with the name at each zoom."""
    return cache.groupBy("lat3", "lng3").agg(
        F.max(F.when(F.col("zoom") == 10, address_name(F.col("addr")))).alias("name10"),
        F.max(F.when(F.col("zoom") == 8, address_name(F.col("addr")))).alias("name8"),
    )


def _resolve(df: DataFrame, side: str, names: DataFrame | None) -> DataFrame:
    lat, lng = F.col(f"{side}_lat"), F.col(f"{side}_lng")
    if names is not None:
        df = (
            df.withColumns({"lat3": cache_key(lat), "lng3": cache_key(lng)})
            .join(names, ["lat3", "lng3"], "left")
            .drop("lat3", "lng3")
        )
    else:
        empty = F.lit(None).cast("string")
        df = df.withColumns({"name10": empty, "name8": empty})
    df = with_city(df, f"{side}_lat", f"{side}_lng", "_city")
    df = df.withColumn("_bad", coord_error(f"{side}_lat", f"{side}_lng").isNotNull())
    source = F.expr(
        "CASE WHEN _bad THEN 'invalid' WHEN name10 IS NOT NULL THEN 'zoom10' WHEN name8 IS NOT NULL "
        "THEN 'zoom8' WHEN _city IS NOT NULL THEN 'city' ELSE 'bucket' END"
    )
    bucket = bucket_name(f"{side}_lat", f"{side}_lng")
    place = F.when(F.col("_bad"), F.lit("invalid_coord")).otherwise(F.coalesce("name10", "name8", "_city", bucket))
    return df.withColumns({f"{side}_place": place, f"{side}_source": source}).drop("name10", "name8", "_bad", "_city")


def assign_places(df: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Add pickup and delivery place, where each name came from, and the lane."""
    names = cache_names(cache) if cache is not None else None
    out = _resolve(_resolve(df, "pickup", names), "delivery", names)
    degraded = F.expr("pickup_source IN ('bucket', 'invalid') OR delivery_source IN ('bucket', 'invalid')")
    return out.withColumns(
        {
            "lane": F.concat_ws(" → ", "pickup_place", "delivery_place"),
            "degraded_place": degraded,
        }
    )
