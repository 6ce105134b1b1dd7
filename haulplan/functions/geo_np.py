"""The same distances on numpy arrays, for the grouped helpers."""

from __future__ import annotations

import numpy as np

from . import constants as K


def haversine_km(lat1, lng1, lat2, lng2):
    la1, la2 = np.radians(lat1), np.radians(lat2)
    a = (
        np.sin((la2 - la1) / 2) ** 2
        + np.cos(la1) * np.cos(la2) * np.sin(np.radians(np.subtract(lng2, lng1)) / 2) ** 2
    )
    return 2 * K.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))


def bearing_deg(lat1, lng1, lat2, lng2):
    la1, la2, dlng = np.radians(lat1), np.radians(lat2), np.radians(np.subtract(lng2, lng1))
    east = np.sin(dlng) * np.cos(la2)
    north = np.cos(la1) * np.sin(la2) - np.sin(la1) * np.cos(la2) * np.cos(dlng)
    return (np.degrees(np.arctan2(east, north)) + 360.0) % 360.0


def bearing_diff(b1, b2):
    d = np.abs(np.subtract(b1, b2)) % 360.0
    return np.minimum(d, 360.0 - d)


def drop_legs(p1, d1, p2, d2):
    """Haversine legs midpoint->d1, midpoint->d2, d1->d2; points are (lat, lng)."""
    o = (np.add(p1[0], p2[0]) / 2, np.add(p1[1], p2[1]) / 2)
    return haversine_km(*o, *d1), haversine_km(*o, *d2), haversine_km(*d1, *d2)


def detour_offset(p1, d1, p2, d2):
    to_1, to_2, between = drop_legs(p1, d1, p2, d2)
    longer = np.maximum(to_1, to_2)
    best = np.minimum(to_1, to_2) + between
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.maximum((best - longer) / longer, 0.0)
    return np.where(longer <= 0, 0.0, ratio)


def detour_multiplier(to_1, to_2, between):
    """Best of the two drop orders, each over the direct leg of its last drop."""
    with np.errstate(divide="ignore", invalid="ignore"):
        first_1 = np.where(to_2 > 0, (to_1 + between) / to_2, 1.0)
        first_2 = np.where(to_1 > 0, (to_2 + between) / to_1, 1.0)
    return np.minimum(first_1, first_2)
