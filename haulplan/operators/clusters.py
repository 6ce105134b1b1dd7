"""Origin and destination clusters over places.

Shipments are summed up to places first. A place table is bounded by the map
(city boxes and 0.2 degree cells), never by the number of shipments. A sweep's
places arrive as sorted rows of a partition and leave as rows; all periods and
scenarios run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, floor, radians, sin, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..plans.params import per_scenario, scenario_value
from ..session import spread

MICRO = 1_000_000  # centroids are kept as whole micro-degree sums and a count
SUMS = ("n", "plat", "plng", "dlat", "dlng")


def lane_sums(shipments: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Counts and coordinate sums per key, combined on the map side; ``more`` aggregates ride along."""
    def micro(c: str) -> Column:
        return F.sum(F.round(F.col(c) * MICRO).cast("long"))

    return shipments.groupBy(*keys).agg(
        F.count("*").alias("n"),
        micro("pickup_lat").alias("plat"), micro("pickup_lng").alias("plng"),
        micro("delivery_lat").alias("dlat"), micro("delivery_lng").alias("dlng"), *more,
    )


def add_up(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = radians(a[0]), radians(b[0])
    x = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * K.EARTH_RADIUS_KM * asin(sqrt(min(max(x, 0.0), 1.0)))


class LiveGrid:
    """Centroids in cells no smaller than the radius: whatever is near lies in the nine cells around."""

    def __init__(self, points: list[tuple[float, float]], radius: float):
        degree = radians(1) * K.EARTH_RADIUS_KM
        # distances shrink with the cosine of the latitude; means stay within the latitudes of the places
        narrow = max(cos(radians(min(max((abs(lat) for lat, _ in points), default=0.0), 90.0))), 1e-3)
        self.high = max(radius, 1e-3) * 1.001 / degree
        # a chord of the radius at high latitude spans more degrees than radius / cosine; the margin covers it
        self.wide = 1.05 * self.high / narrow
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.at: dict[int, tuple[int, int]] = {}
        for i, point in enumerate(points):
            self.put(i, point)

    def put(self, i: int, point: tuple[float, float]) -> None:
        cell = floor(point[0] / self.high), floor(point[1] / self.wide)
        if self.at.get(i) == cell:
            return
        self.drop(i)
        self.at[i] = cell
        self.cells.setdefault(cell, set()).add(i)

    def drop(self, i: int) -> None:
        cell = self.at.pop(i, None)
        if cell is not None:
            own = self.cells[cell]
            own.discard(i)
            if not own:
                del self.cells[cell]

    def around(self, i: int) -> Iterator[int]:
        row, column = self.at[i]
        for a in (row - 1, row, row + 1):
            for b in (column - 1, column, column + 1):
                yield from self.cells.get((a, b), ())


def sweep(names, n, slat, slng, radius: float) -> list[str]:
    """Merge places whose live centroids lie within ``radius`` km.

    Pairs are visited once, in name order; after a merge the pooled centroid
    counts. A cluster carries its first name. A place asks only the clusters in
    the cells around its own; the next partner is the first of their members
    that is still to come.
    """
    size = len(names)
    sums = [[float(a), float(b), float(c)] for a, b, c in zip(n, slat, slng)]

    def centroid(i: int) -> tuple[float, float]:
        count, lat, lng = sums[i]
        return lat / count / MICRO, lng / count / MICRO

    points = [centroid(i) for i in range(size)]
    grid, root, members = LiveGrid(points, radius), list(range(size)), [[i] for i in range(size)]
    for i in range(size - 1):
        j = i + 1
        while j < size:
            mine, partner, found = root[i], size, -1
            for other in grid.around(mine):
                # members are few where clusters are near each other; each is passed once it lies behind
                if other != mine and members[other][-1] >= j and _km(points[mine], points[other]) <= radius:
                    first = next(m for m in members[other] if m >= j)
                    if first < partner:
                        partner, found = first, other
            if found < 0:
                break
            for k in range(3):
                sums[mine][k] += sums[found][k]
            points[mine] = centroid(mine)
            grid.drop(found)
            grid.put(mine, points[mine])
            for m in members[found]:
                root[m] = mine
            members[mine] = sorted(members[mine] + members[found])
            members[found] = []
            j = partner + 1
    first: dict[int, str] = {}
    return [first.setdefault(r, name) for r, name in zip(root, names)]


def _cluster(sums: DataFrame, keys: list[str], place: str, lat: str, lng: str, radius: Column, out: str) -> DataFrame:
    """(keys, place) -> cluster name."""
    rows = sums.select(*keys, place, "n", F.col(lat).alias("slat"), F.col(lng).alias("slng"), radius.cast("double").alias("radius"))
    in_order = spread(rows, *keys).sortWithinPartitions(*keys, place)

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def swept():
            names, *numbers, radii = zip(*held)
            found = sweep(names, *numbers, radii[0])
            columns = [*([k] * len(held) for k in group), names, found]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

        fields = []
        for batch in batches:
            fields = [batch.schema.field(c) for c in (*keys, place)] + [pa.field(out, pa.string())]
            columns = [batch.column(c).to_pylist() for c in (*keys, place, "n", "slat", "slng", "radius")]
            for row in zip(*columns):
                if row[: len(keys)] != group and held:
                    yield swept()
                    held = []
                group = row[: len(keys)]
                held.append(row[len(keys) :])
        if held:
            yield swept()

    types = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in (*keys, place))
    return in_order.mapInArrow(clusters, f"{types}, `{out}` string")


def origin_clusters(lanes: DataFrame, scenarios) -> DataFrame:
    """(scenario, period, pickup_place) -> origin_cluster."""
    places = per_scenario(add_up(lanes, ["period", "pickup_place"]), scenarios)
    return _cluster(
        places, ["scenario_id", "period"], "pickup_place", "plat", "plng",
        scenario_value("pickup_radius_km", scenarios), "origin_cluster",
    )


def destination_clusters(lanes: DataFrame, origins: DataFrame, scenarios) -> DataFrame:
    """(scenario, period, origin_cluster, delivery_place) -> dest_cluster."""
    keys = ["scenario_id", "period", "origin_cluster"]
    places = add_up(lanes.join(origins, ["period", "pickup_place"]), keys + ["delivery_place"])
    return _cluster(
        places, keys, "delivery_place", "dlat", "dlng",
        scenario_value("delivery_cluster_km", scenarios), "dest_cluster",
    )


def lane_clusters(lanes: DataFrame, scenarios) -> DataFrame:
    """(scenario, period, pickup_place, delivery_place) -> both clusters."""
    origins = origin_clusters(lanes, scenarios)
    dests = destination_clusters(lanes, origins, scenarios)
    return (
        lanes.select("period", "pickup_place", "delivery_place")
        .join(origins, ["period", "pickup_place"])
        .join(dests, ["scenario_id", "period", "origin_cluster", "delivery_place"])
    )
