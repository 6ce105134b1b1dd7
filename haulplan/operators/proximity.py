"""Spatial joins by grid cells: places near each other, missed partners, window partners."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine_km
from ..functions.rounding import rnd
from ..session import Stages

KM_PER_DEG = 2 * math.pi * K.EARTH_RADIUS_KM / 360.0


def _cell(lat: Column, lng: Column, deg: float) -> tuple[Column, Column]:
    return F.floor(lat / F.lit(deg)).cast("int"), F.floor(lng / F.lit(deg)).cast("int")


def _reach(lat: Column, lng: Column, km: float, deg: float) -> tuple[Column, Column]:
    """Cell rows and columns that a circle of ``km`` around a point can touch.

    The longitude span grows with the latitude of the circle's far edge.
    """
    d_lat = km / KM_PER_DEG * 1.001
    edge = F.least(F.abs(lat) + F.lit(d_lat), F.lit(89.0))
    d_lng = F.least(F.lit(d_lat) / F.cos(F.radians(edge)) * F.lit(1.01), F.lit(180.0))
    band = lambda c, d: F.sequence(
        F.floor((c - d) / F.lit(deg)).cast("int"), F.floor((c + d) / F.lit(deg)).cast("int")
    )
    return band(lat, F.lit(d_lat)), band(lng, d_lng)


def pairs_within(points: DataFrame, radius_km: float, keys=(), name: str = "place") -> DataFrame:
    """Pairs of places at most ``radius_km`` apart, a < b.

    ``points`` is place-grained (name, lat, lng), so its size is bounded by the
    map. Each place meets only the places of the cells it can reach.
    """
    deg = radius_km / KM_PER_DEG
    keys = list(keys)
    r, c = _cell(F.col("lat"), F.col("lng"), deg)
    right = points.select(*keys, F.col(name).alias("b"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), r.alias("r"), c.alias("c"))
    rows, cols = _reach(F.col("lat"), F.col("lng"), radius_km, deg)
    left = (
        points.select(*keys, F.col(name).alias("a"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), rows.alias("rs"), cols.alias("cs"))
        .withColumn("r", F.explode("rs"))
        .withColumn("c", F.explode("cs"))
        .drop("rs", "cs")
    )
    km = rnd(haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")), 6)
    return (
        left.join(right, [*keys, "r", "c"])
        .filter(F.col("a") < F.col("b"))
        .withColumn("km", km)
        .filter(F.col("km") <= radius_km)
        .select(*keys, "a", "b", "km")
    )


#: A cell with more shipments than this is halved along all four axes until its parts hold about so many.
BOX_ROWS = 64
_BOX = ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng")
_SUB = ("s0", "s1", "s2", "s3")


def _halvings(n: Column) -> Column:
    """How often a cell of ``n`` shipments is halved; every halving makes 16 parts."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(BOX_ROWS))) / 4)).cast("int")


def _extent():
    return [f(c).alias(f"{f.__name__}_{c}") for c in _BOX for f in (F.min, F.max)]


def _half_chord(d_lat: Column, d_lng: Column, cos_a: Column, cos_b: Column) -> Column:
    """The haversine of a distance, from its parts in degrees; it grows with each of them."""
    sin2 = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    return sin2(d_lat) + cos_a * cos_b * sin2(d_lng)


def _box_verdict(sides: dict[str, float]) -> Column:
    """``in`` if every point of a box is close to the probe at both ends, ``out`` if none is, else ``open``."""
    verdict = []
    for s, km in sides.items():
        lat, lng = F.col(f"q_{s}_lat"), F.col(f"q_{s}_lng")
        lo, hi, west, east = (F.col(f"{f}_{s}_{c}") for c in ("lat", "lng") for f in ("min", "max"))
        away = lambda x, a, b: F.greatest(a - x, x - b, F.lit(0.0))
        across = lambda x, a, b: F.greatest(F.abs(a - x), F.abs(b - x))
        cos = [F.cos(F.radians(x)) for x in (lo, hi)]
        most = F.when((lo <= 0) & (hi >= 0), 1.0).otherwise(F.greatest(*cos))
        # the shorter way round the globe is at most the plain difference, so only boxes on one side of it may be ruled out
        wide = across(lng, west, east) > 180
        near = _half_chord(away(lat, lo, hi), F.when(wide, 0.0).otherwise(away(lng, west, east)), F.cos(F.radians(lat)), F.least(*cos))
        far = _half_chord(across(lat, lo, hi), F.least(across(lng, west, east), F.lit(180.0)), F.cos(F.radians(lat)), most)
        limit = math.sin(km / (2 * K.EARTH_RADIUS_KM)) ** 2
        verdict.append((near > limit * 1.00001, far < limit * 0.99999))
    return F.when(verdict[0][0] | verdict[1][0], "out").when(verdict[0][1] & verdict[1][1], "in").otherwise("open")


def missed_partners(
    singles: DataFrame, keys=(), id_col: str = "shipment_id",
    pickup_km: float = K.MISSED_PICKUP_KM, delivery_km: float = K.MISSED_DELIVERY_KM, stages: Stages | None = None,
) -> DataFrame:
    """Add ``missed``: another single has pickup and delivery close by.

    Cells are small enough that two shipments in one cell are always close, so
    a cell with two or more needs no pair test at all. Only a shipment alone in
    its cell looks at the cells around it; there is at most one such shipment
    per cell. It is held against the bounding box of what a cell holds: a box
    that is close as a whole settles the shipment, one that is far as a whole
    is left. Only boxes across the limit are opened; crowded cells are halved
    again and again first, so that rows are met in small boxes alone, and by
    as many tasks as there are boxes.
    """
    keys, stages = list(keys), stages or Stages(singles.sparkSession)
    p_deg, d_deg = (0.99 * km / KM_PER_DEG / math.sqrt(2.0) for km in (pickup_km, delivery_km))
    degrees = dict(zip(_BOX, (p_deg, p_deg, d_deg, d_deg)))
    pr, pc = _cell(F.col("pickup_lat"), F.col("pickup_lng"), p_deg)
    dr, dc = _cell(F.col("delivery_lat"), F.col("delivery_lng"), d_deg)
    cell = ["pr", "pc", "dr", "dc"]
    df = stages.save(singles.withColumns(dict(zip(cell, (pr, pc, dr, dc)))), "singles")
    sizes = df.groupBy(*keys, *cell).agg(F.count("*").alias("in_cell"), F.first(id_col).alias(f"q_{id_col}"), *_extent())
    sizes = stages.save(sizes, "cells")

    alone = sizes.filter("in_cell = 1").select(
        *keys, f"q_{id_col}", *[F.col(f"min_{c}").alias(f"q_{c}") for c in _BOX], F.struct(*cell).alias("own")
    )
    near_p = _reach(F.col("q_pickup_lat"), F.col("q_pickup_lng"), pickup_km, p_deg)
    near_d = _reach(F.col("q_delivery_lat"), F.col("q_delivery_lng"), delivery_km, d_deg)
    around = lambda d, names, spans: d.withColumn(names[0], F.explode(spans[0])).withColumn(names[1], F.explode(spans[1]))
    # neighbours are met as occupied cells first, pickups before deliveries, so empty cells cost little
    probes = around(alone, cell[:2], near_p).join(sizes.select(*keys, *cell[:2]).distinct(), [*keys, *cell[:2]], "left_semi")
    sides = {"pickup": pickup_km, "delivery": delivery_km}
    probe = [*keys, f"q_{id_col}", *[f"q_{c}" for c in _BOX], *cell, "halvings"]
    met = (
        around(probes, cell[2:], near_d)
        .filter(F.col("own") != F.struct(*cell))
        .join(sizes.select(*keys, *cell, _halvings(F.col("in_cell")).alias("halvings"), *[c for c in sizes.columns if c[:4] in ("min_", "max_")]), [*keys, *cell])
        .select(*probe, *[F.lit(0).alias(s) for s in _SUB], _box_verdict(sides).alias("verdict"))
        .filter("verdict != 'out'")
    )
    deepest = sizes.agg(F.max(_halvings(F.col("in_cell")))).first()[0] or 0
    who = [*keys, f"q_{id_col}"]
    rows = df.select(*keys, *cell, id_col, *_BOX).join(sizes.select(*keys, *cell, _halvings(F.col("in_cell")).alias("halvings")), [*keys, *cell])
    part = lambda c, at, level: F.least(
        F.greatest(F.floor((F.col(c) / F.lit(degrees[c]) - F.col(at)) * F.lit(2.0) ** level), F.lit(0)),
        (F.lit(2.0) ** level).cast("long") - 1,
    ).cast("int")
    parts = lambda level: {s: part(c, at, level) for s, c, at in zip(_SUB, _BOX, cell)}
    settled, leaves = [], []
    for level in range(deepest + 1):
        if level:
            boxes = rows.filter(F.col("halvings") >= level).withColumns(parts(F.lit(level))).groupBy(*keys, *cell, *_SUB).agg(*_extent())
            boxes = boxes.withColumns({f"up{s}": F.shiftright(s, 1) for s in _SUB})
            above = deeper.select(*probe, *[F.col(s).alias(f"up{s}") for s in _SUB])
            met = above.join(boxes, [*keys, *cell, *[f"up{s}" for s in _SUB]]).select(*probe, *_SUB, _box_verdict(sides).alias("verdict")).filter("verdict != 'out'")
        met = stages.save(met, f"boxes_{level}")
        sure = met.filter("verdict = 'in'").select(*who).distinct()
        settled.append(sure)
        left = met.filter("verdict = 'open'").drop("verdict").join(sure, who, "left_anti")
        leaves.append(left.filter(F.col("halvings") == level))
        deeper = left.filter(F.col("halvings") > level)
    dist = lambda s: rnd(haversine_km(F.col(f"q_{s}_lat"), F.col(f"q_{s}_lng"), F.col(f"{s}_lat"), F.col(f"{s}_lng")), 6)
    small, sure = reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, settled)
    tested = (
        rows.withColumns(parts(F.col("halvings"))).drop("halvings")
        .join(small.join(sure, who, "left_anti").drop("halvings"), [*keys, *cell, *_SUB])
        .filter((dist("pickup") <= pickup_km) & (dist("delivery") <= delivery_km))
        .select(*who)
    )
    found = sure.unionByName(tested).groupBy(*keys, F.col(f"q_{id_col}").alias(id_col)).agg(F.lit(True).alias("_near"))
    return (
        df.join(sizes.select(*keys, *cell, "in_cell"), [*keys, *cell])
        .join(found, [*keys, id_col], "left")
        .withColumn("missed", (F.col("in_cell") > 1) | F.coalesce("_near", F.lit(False)))
        .drop(*cell, "in_cell", "_near")
    )


def missed_share(flagged: DataFrame, keys=()) -> DataFrame:
    """Per cent of singles that are unavoidable and that missed a partner."""
    unavoidable = rnd(F.count_if(~F.col("missed")) / F.count("*") * 100.0, 0)
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("singletons"),
        F.count_if("missed").alias("missed"),
        unavoidable.alias("unavoidable_pct"),
        (F.lit(100.0) - unavoidable).alias("missed_pct"),
    )


def overlap_partners(shipments: DataFrame, lane: list[str], stages: Stages | None = None) -> DataFrame:
    """Per shipment: lane mates, and how many of their windows overlap its own.

    Two windows are apart when one ends no later than the other starts. Both
    cases are counted from running totals over the lane's distinct times, so
    no pair is ever built. The totals are a stage table, made once; shipments meet them by
    hash and are not sorted.
    """
    stages = stages or Stages(shipments.sparkSession)
    event = lambda c, opened: F.struct(F.col(c).alias("t"), F.lit(opened).alias("o"), F.lit(1 - opened).alias("c"))
    events = shipments.select(*lane, F.explode(F.array(event("earliest_s", 1), event("latest_s", 0))).alias("x"))
    in_time = Window.partitionBy(*lane).orderBy("t")
    upto, every = (in_time.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    clock = (
        events.groupBy(*lane, F.col("x.t").alias("t"))
        .agg(F.sum("x.o").alias("opened"), F.sum("x.c").alias("closed"))
        .select(
            *lane, "t",
            F.sum("closed").over(upto).alias("closed_by"),
            (F.sum("opened").over(every) - F.sum("opened").over(upto) + F.col("opened")).alias("opened_from"),
            F.sum("opened").over(every).alias("total"),
        )
    )
    clock = stages.save(clock, "clock")
    at_start = clock.select(*lane, F.col("t").alias("earliest_s"), "closed_by", "total")
    at_end = clock.select(*lane, F.col("t").alias("latest_s"), "opened_from")
    return (
        shipments.join(at_start.hint("shuffle_hash"), [*lane, "earliest_s"])
        .join(at_end.hint("shuffle_hash"), [*lane, "latest_s"])
        .withColumn("lane_mates", F.col("total") - 1)
        .withColumn("overlapping", F.col("total") - 1 - F.col("closed_by") - F.col("opened_from"))
        .drop("closed_by", "opened_from", "total")
    )
