"""Vehicle choice, truck figures, exceptions, vehicle numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.measures import (
    best_vehicle, co2_kg, fleet_literal, load_factor, trip_cost, vehicle_attr,
)
from ..functions.rounding import rnd
from ..sources.fleet import BY_PAYLOAD, FLEET, LARGEST


def fitting_vehicles(kg: str, volume: str) -> Column:
    """Vehicle types that take a load, smallest payload first.

    By weight and volume where any type does, else by weight only. Volume
    beyond the largest hold is taken at half, at most one full hold. The fleet
    is a literal array, so the inequality join happens inside the row.
    """
    fleet, hold = fleet_literal(), f"{LARGEST.hold_cm3}D"
    volume = f"IF({volume} > {hold}, least({volume} * 0.5D, {hold}), {volume})"
    both = f"filter({fleet}, v -> v.kg >= {kg} AND v.cm3 >= {volume})"
    weight = f"filter({fleet}, v -> v.kg >= {kg})"
    return F.expr(f"transform(IF(size({both}) > 0, {both}, {weight}), v -> v.name)")


def vehicle_columns(df: DataFrame, name: str, attrs: dict[str, str]) -> DataFrame:
    """Attributes of the assigned vehicle, from one literal map lookup."""
    entries = []
    for v in BY_PAYLOAD:
        values = ", ".join(
            f"'{out}', " + (f"'{getattr(v, a)}'" if isinstance(getattr(v, a), str) else f"{float(getattr(v, a))}D")
            for out, a in attrs.items()
        )
        entries.append(f"WHEN '{v.name}' THEN named_struct({values})")
    df = df.withColumn("_v", F.expr(f"CASE {name} {' '.join(entries)} END"))
    return df.withColumns({out: F.col(f"_v.{out}") for out in attrs}).drop("_v")


def split_oversize(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes a vehicle can carry, exceptions: one shipment above every payload)."""
    heavy = F.col("group_u") > K.MAX_PAYLOAD_U
    exceptions = routes.filter(heavy).select(
        "scenario_id", "period", F.col("route_id").alias("truck_id"),
        F.element_at("items.shipment_id", 1).alias("shipment_id"),
        F.element_at("items.weight_kg", 1).alias("weight_kg"),
        F.lit(True).alias("oversize"), F.lit("OVERSIZE").alias("assigned_vehicle"),
    )
    return routes.filter(~heavy), exceptions


def choose_vehicles(routes: DataFrame) -> DataFrame:
    """Truck weight, volume, distance and the right-sized vehicle per route.

    The weight is a sum of whole grams, so a load of exactly the payload fits.
    A route within the payload that no vehicle carries is an error; one beyond it has none.
    """
    sides = lambda x: " * ".join(f"coalesce(nullif(double({x}.{s}), 0D), 1D)" for s in ("length_cm", "width_cm", "height_cm"))
    alone = F.col("group_size") == 1
    df = routes.withColumns(
        {
            "weight_kg": F.col("group_u") / F.lit(float(K.WEIGHT_UNITS_PER_KG)),
            "box_cm3": F.when(alone, F.expr(f"0D + {sides('items[0]')}")).otherwise(
                F.expr(f"aggregate(items, 0D, (a, x) -> a + {sides('x')})")
            ),
            "route_km_used": F.when(alone, F.col("items")[0]["route_km"]).otherwise(F.array_max("items.route_km")),
        }
    )
    df = df.withColumn("convoy", F.col("box_cm3") > LARGEST.hold_cm3)
    chosen = best_vehicle("weight_kg", "box_cm3", "route_km_used")
    chosen = F.when(F.col("convoy"), F.lit(LARGEST.name)).otherwise(chosen)
    missing = F.when(F.col("group_u") <= K.MAX_PAYLOAD_U, F.raise_error(F.concat(F.lit("no vehicle carries route "), "route_id")))
    return df.withColumn("assigned_vehicle", F.coalesce(chosen, missing))


#: What ``choose_vehicles`` adds.
CHOICE = ("weight_kg", "box_cm3", "route_km_used", "convoy", "assigned_vehicle")


SPEC = {
    "_max": "max_kg", "_l": "l", "_w": "w", "_h": "h", "_fix": "fixed_cost_per_trip", "_km": "cost_per_km",
    "_ckm": "co2_per_km_kg", "_ctk": "co2_per_ton_km", "vehicle_class": "truck_class",
}


def with_hold(trucks: DataFrame) -> DataFrame:
    return vehicle_columns(trucks, "assigned_vehicle", SPEC).withColumn("hold", F.array("_l", "_w", "_h", "_max"))


def truck_figures(loaded: DataFrame) -> DataFrame:
    """Utilisation, load factor, cost and CO2 from the loaded truck."""
    cap = F.col("_l") * F.col("_w") * F.col("_h")
    kg, km = F.col("weight_kg"), F.col("route_km_used")
    w_ratio, v_ratio = kg / F.col("_max"), F.col("used_cm3") / cap
    return loaded.withColumns(
        {
            "group_weight_kg": rnd(kg, 2),
            "group_volume_cm3": rnd(F.col("used_cm3"), 0),
            "weight_utilization": rnd(F.least(w_ratio, F.lit(1.0)), 3),
            "volume_utilization": rnd(F.least(v_ratio, F.lit(1.0)), 3),
            "spatial_utilization": rnd(v_ratio, 3),
            "load_factor": rnd(load_factor(w_ratio, v_ratio), 3),
            "cost_estimate_inr": rnd(trip_cost(F.col("_fix"), F.col("_km"), km), 0),
            "co2_kg_estimate": rnd(co2_kg(F.col("_ckm"), F.col("_ctk"), kg, km), 2),
            "stacking_layers": F.col("layers"),
            "oversize": F.lit(False),
            "bulk_boxes": F.size(F.filter("load", lambda b: b["bulk"])),
        }
    ).drop(*[c for c in SPEC if c.startswith("_")], "layers")


RANK_BUCKETS = 3  # hex digits of the md5 used to cut a long ranking
HOT_ROWS = 1_000_000  # a key with more rows is ranked in buckets


def by_heat(df: DataFrame, keys: list[str], needed: list[str], bound: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that one task can sort, and those of the hot keys, both with the bucket ``_b`` of the id (last of ``needed``).

    Rows with a null among ``needed`` have no place in an order and are left
    out. At most one key in ``HOT_ROWS`` rows is hot, so their list is broadcast.
    ``bound`` names a column that no key's rows exceed; only keys that it leaves open are counted.
    """
    known = df
    for c in dict.fromkeys([*keys, *needed]):
        known = known.filter(F.col(c).isNotNull())
    open_keys = known if bound is None else known.filter(F.col(bound) > HOT_ROWS)
    hot = F.broadcast(open_keys.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).select(*keys))
    cut = known.withColumn("_b", F.substring(F.md5(F.col(needed[-1])), 1, RANK_BUCKETS))
    return cut.join(hot, keys, "left_anti"), cut.join(hot, keys, "left_semi")


def ranked(df: DataFrame, keys: list[str], id_col: str, out: str = "rank", order: tuple[str, ...] = (), bound: str | None = None) -> DataFrame:
    """Exact 1-based rank within ``keys`` without a single sorted pile.

    Rows are ordered by ``order``, the first digits of the id's md5, then by id. A key of
    bounded size is sorted whole: its rows move once. ``df`` is read more than
    once, so it had better be a stage table. ``bound`` as in ``by_heat``.
    """
    cool, hot = by_heat(df, keys, [*order, id_col], bound)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_b", id_col)).cast("long")
    return cool.withColumn(out, place).drop("_b").unionByName(ranked_in_buckets(hot, keys, id_col, out, order))


def ranked_in_buckets(cut: DataFrame, keys: list[str], id_col: str, out: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The same rank for hot keys, whose rows have the bucket ``_b``.

    Bucket counts give each bucket its offset, so a key that holds a third of
    all rows is still ranked by thousands of tasks.
    """
    parts = [*keys, *order, "_b"]
    sizes = cut.groupBy(*parts).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*order, "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*parts).orderBy(id_col)
    return (
        cut.join(offsets, parts)
        .withColumn(out, F.col("_off") + F.row_number().over(inside))
        .drop("_b", "_off")
    )


def vehicle_numbers(trucks: DataFrame, keys=("scenario_id", "period")) -> DataFrame:
    """Number every truck: the type's listed number first, then ``name-OVF-k``."""
    numbered = ranked(trucks, [*keys, "assigned_vehicle"], "truck_id", "vehicle_rank")
    listed = vehicle_attr(F.col("assigned_vehicle"), "vehicle_no")
    overflow = F.concat("assigned_vehicle", F.lit("-OVF-"), F.col("vehicle_rank").cast("string"))
    return numbered.withColumn("assigned_vehicle_no", F.when(F.col("vehicle_rank") == 1, listed).otherwise(overflow))


def pool_status(trucks: DataFrame, keys=("scenario_id", "period")) -> DataFrame:
    """Per vehicle type: vehicles known (listed and overflow), busy, available."""
    used = trucks.groupBy(*keys, F.col("assigned_vehicle").alias("name")).agg(F.count("*").alias("busy"))
    runs = trucks.select(*keys).distinct()
    names = F.array(*[F.lit(v.name) for v in FLEET])
    return (
        runs.withColumn("name", F.explode(names))
        .join(used, [*keys, "name"], "left")
        .withColumn("busy", F.coalesce("busy", F.lit(0)))
        .withColumn("total", F.greatest(F.col("busy"), F.lit(1)))
        .withColumn("available", F.col("total") - F.col("busy"))
    )


def clock(seconds: Column) -> Column:
    """Time of day as HH:MM."""
    minutes = F.floor(seconds % 86_400 / 60)
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def manifest(trucks: DataFrame) -> DataFrame:
    """Dispatch manifest: eighteen columns per truck, ``dispatch_from`` and ``dispatch_to`` being clock times."""
    day = lambda f: F.transform(f"items.{f}", lambda s: s % 86_400)
    return trucks.select(
        "truck_id", F.col("assigned_vehicle").alias("vehicle_name"), "vehicle_class",
        F.concat_ws(",", F.sort_array("items.shipment_id")).alias("shipment_ids"),
        F.size("items").alias("n_shipments"),
        F.col("group_weight_kg").alias("weight_kg"), "load_factor",
        F.col("weight_utilization").alias("weight_util"), F.col("volume_utilization").alias("volume_util"),
        F.col("spatial_utilization").alias("spatial_util"), F.col("route_km_used").alias("route_km"),
        F.col("cost_estimate_inr").alias("cost_inr"), F.col("co2_kg_estimate").alias("co2_kg"),
        clock(F.array_min(day("earliest_s"))).alias("dispatch_from"), clock(F.array_max(day("latest_s"))).alias("dispatch_to"),
        "axle_balance_ok", "convoy", F.lit(1).alias("convoy_position"), "stacking_layers",
        *[c for c in ("scenario_id", "period", "assigned_vehicle_no") if c in trucks.columns],
    )
