"""Distances, bearings, detours and grid cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .rounding import rnd


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlng = F.radians(lng2 - lng1)
    sin_lat = F.sin(dlat / 2)
    sin_lng = F.sin(dlng / 2)
    a = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lng * sin_lng
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def road_km(lat1, lng1, lat2, lng2) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2) * F.lit(K.ROAD_FACTOR)


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    """Compass bearing from the first point to the second, in [0, 360)."""
    la1, la2, dlng = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    east = F.sin(dlng) * F.cos(la2)
    north = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(dlng)
    return F.pmod(F.degrees(F.atan2(east, north)) + F.lit(360.0), F.lit(360.0))


def bearing_diff(b1, b2) -> Column:
    d = F.abs(b1 - b2) % F.lit(360.0)
    return F.least(d, F.lit(360.0) - d)


def _legs(a: dict, b: dict, dist):
    """Distances of the two drop orders from the shared midpoint origin."""
    o_lat = (a["plat"] + b["plat"]) / 2
    o_lng = (a["plng"] + b["plng"]) / 2
    to_a = dist(o_lat, o_lng, a["dlat"], a["dlng"])
    to_b = dist(o_lat, o_lng, b["dlat"], b["dlng"])
    between = dist(a["dlat"], a["dlng"], b["dlat"], b["dlng"])
    return to_a, to_b, between


def detour_offset(a: dict, b: dict) -> Column:
    """Extra distance of the better drop order over the longer direct leg.

    0.10 means ten per cent extra; 0 when both legs have no length. ``a`` and
    ``b`` hold the columns plat, plng, dlat, dlng.
    """
    to_a, to_b, between = _legs(a, b, haversine_km)
    longer = F.greatest(to_a, to_b)
    best = F.least(to_a, to_b) + between
    return F.when(longer <= 0, F.lit(0.0)).otherwise(
        F.greatest((best - longer) / longer, F.lit(0.0))
    )


def detour_multiplier(anchor: dict, rider: dict) -> tuple[Column, Column]:
    """Best ratio of route length to the direct leg of the last drop, and its order."""
    return detour_of_legs(*road_legs(anchor, rider))


def road_legs(anchor: dict, rider: dict) -> tuple[Column, Column, Column]:
    """Road km from the shared origin to either drop, and between the drops."""
    return _legs(anchor, rider, road_km)


def detour_of_legs(to_a: Column, to_r: Column, between: Column) -> tuple[Column, Column]:
    """``detour_multiplier`` from its legs; as columns of their own these are worked out once a row."""
    anchor_first = F.when(to_r > 0, (to_a + between) / to_r).otherwise(F.lit(1.0))
    rider_first = F.when(to_a > 0, (to_r + between) / to_a).otherwise(F.lit(1.0))
    order = F.when(rnd(anchor_first, 9) <= rnd(rider_first, 9), F.lit("anchor_first")).otherwise(
        F.lit("rider_first")
    )
    return F.least(anchor_first, rider_first), order


def grid_step(resolution) -> Column:
    step = F.lit(K.GRID_STEP_OTHER)
    for res, deg in K.GRID_STEP.items():
        step = F.when(F.lit(resolution) == res, F.lit(deg)).otherwise(step)
    return step


def zone_id(lat, lng, resolution) -> Column:
    """Grid corner of a point as text, e.g. ``grid_19.250_73.000_r8``."""
    step = grid_step(resolution)
    # adding 0.0 turns a negative zero into zero
    corner_lat = F.floor(lat / step) * step + F.lit(0.0)
    corner_lng = F.floor(lng / step) * step + F.lit(0.0)
    return F.format_string(
        "grid_%.3f_%.3f_r%d", corner_lat, corner_lng, F.lit(resolution).cast("int")
    )
