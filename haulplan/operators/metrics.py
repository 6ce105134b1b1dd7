"""Reports over a truck table: utilisation, savings, lanes, goods, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import road_km
from ..functions.measures import best_vehicle, co2_kg, lf_band, pack_volume_cm3, trip_cost
from ..functions.rounding import rnd
from .vehicles import vehicle_columns

RUN = ("scenario_id",)


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, rnd(part / whole * 100.0, 1)).otherwise(F.lit(0.0))


def exact_mean(c: str, scale: int = 1000) -> Column:
    """Mean of a rounded column from whole units, so that row order cannot matter."""
    return F.sum(F.round(F.col(c) * scale).cast("long")) / F.count(c) / F.lit(float(scale))


def exact_sum(c: str, scale: int = 100) -> Column:
    return F.sum(F.round(F.col(c) * scale).cast("long")) / F.lit(float(scale))


def utilization(trucks: DataFrame, keys=RUN) -> DataFrame:
    """Mean load factor, weight, volume and spatial use; total cost and CO2."""
    mean = lambda c: rnd(exact_mean(c), 3).alias(f"avg_{c}")
    return trucks.groupBy(*keys).agg(
        F.count("*").alias("trucks"),
        mean("load_factor"), mean("weight_utilization"), mean("volume_utilization"), mean("spatial_utilization"),
        rnd(exact_sum("cost_estimate_inr", 1), 0).alias("total_cost_inr"),
        rnd(exact_sum("co2_kg_estimate"), 2).alias("total_co2_kg"),
    )


def vehicle_mix(trucks: DataFrame, keys=RUN) -> DataFrame:
    return trucks.groupBy(*keys, "assigned_vehicle").agg(F.count("*").alias("trucks"))


def consolidation_summary(trucks: DataFrame, keys=RUN) -> DataFrame:
    """Shipments, trucks, singles, batches, group types, trip reduction."""
    many = F.col("group_size") > 1
    agg = trucks.groupBy(*keys).agg(
        F.sum("group_size").alias("n_shipments"),
        F.count("*").alias("n_trucks"),
        F.count_if(~many).alias("n_singletons"),
        F.count_if(many).alias("n_batched_groups"),
        F.sum(F.when(many, F.col("group_size")).otherwise(0)).alias("n_batched_shipments"),
        F.count_if(F.col("consolidation_type") == "exact_lane").alias("exact_lane_groups"),
        F.count_if(F.col("consolidation_type") == "corridor").alias("corridor_groups"),
    )
    return agg.withColumns(
        {
            "trip_reduction_pct": _pct(F.col("n_shipments") - F.col("n_trucks"), F.col("n_shipments")),
            "trips_saved": F.col("n_shipments") - F.col("n_trucks"),
        }
    )


LISTINGS = {
    "groups": (("cluster_n", False), ("cluster_weight_kg", False), ("group_id", True)),
    "routes": (("group_size", False), ("weight_kg", False), ("route_id", True)),
    "trucks": (("load_factor", False), ("truck_id", True)),
    "manifest": (("assigned_vehicle_no", True), ("truck_id", True)),
}


def listing(df: DataFrame, kind: str) -> DataFrame:
    """Rows in the order a reader sees them, ties by id: groups and routes by size, then weight, trucks by load factor, the manifest by vehicle."""
    return df.orderBy(*[F.col(c).asc() if rising else F.col(c).desc() for c, rising in LISTINGS[kind]])


def lane_efficiency(trucks: DataFrame, keys=RUN) -> DataFrame:
    agg = trucks.groupBy(*keys, F.col("group_lane").alias("lane")).agg(
        F.sum("group_size").cast("long").alias("shipments"),
        F.count("*").alias("trucks"),
        rnd(exact_mean("load_factor") * 100.0, 1).alias("avg_load_factor"),
        rnd(exact_sum("group_weight_kg"), 0).alias("total_weight_kg"),
        rnd(exact_sum("cost_estimate_inr", 1), 0).alias("cost_inr"),
        rnd(exact_sum("co2_kg_estimate"), 1).alias("co2_kg"),
    )
    return agg.withColumn("consolidation_rate", _pct(F.col("shipments") - F.col("trucks"), F.col("shipments")))


LF_BUCKETS = ("Under 40%", "40-60%", "60-80%", "80%+")


def lf_histogram(trucks: DataFrame, keys=RUN) -> DataFrame:
    """Trucks per load-factor bucket; empty buckets count zero."""
    lf = F.col("load_factor") * 100.0
    bucket = F.when(lf < 40, LF_BUCKETS[0]).when(lf < 60, LF_BUCKETS[1]).when(lf < 80, LF_BUCKETS[2]).otherwise(LF_BUCKETS[3])
    counts = trucks.groupBy(*keys).agg(*[F.count_if(bucket == b).alias(b) for b in LF_BUCKETS])
    pairs = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"`{b}`").alias("trucks")) for b in LF_BUCKETS])
    return counts.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def lf_bands(trucks: DataFrame, keys=RUN) -> DataFrame:
    return trucks.groupBy(*keys, lf_band(F.col("load_factor")).alias("band")).agg(
        F.count("*").alias("trucks"),
        F.count_if(F.col("load_factor") < K.DEFER_BELOW_LF).alias("deferral_recommended"),
        F.count_if(F.col("load_factor") < K.LF_FLOOR).alias("low_util"),
    )


def goods_summary(shipments: DataFrame, keys=()) -> DataFrame:
    return shipments.groupBy(*keys, "goods_type").agg(
        F.count("*").alias("shipments"),
        rnd(exact_sum("weight_kg"), 0).alias("total_kg"),
        rnd(exact_mean("weight_kg"), 0).alias("avg_kg"),
    )


def flat_metrics(trucks: DataFrame, exceptions: DataFrame, keys=RUN) -> DataFrame:
    """Console metrics with the flat-rate savings model (a fixed gain per trip saved).

    ``oversize`` counts the shipments no vehicle carries; the means are over
    the trucks.
    """
    saved = F.col("n_shipments") - F.col("n_trucks")
    goods = F.array_distinct("items.goods_type")
    fragile = F.exists(goods, lambda g: g.isin("pharma_medical", "electronics"))
    heavy = F.exists(goods, lambda g: g.isin("steel_metal_parts", "construction_material"))
    mixed = trucks.groupBy(*keys).agg(F.count_if(fragile & heavy).alias("mixed_stackability"))
    over = exceptions.groupBy(*keys).agg(F.count("*").alias("oversize"))
    means = utilization(trucks, keys).select(*keys, "avg_load_factor", "avg_weight_utilization", "avg_volume_utilization")
    return (
        consolidation_summary(trucks, keys)
        .join(means, list(keys))
        .join(over, list(keys), "left")
        .withColumn("oversize", F.coalesce("oversize", F.lit(0)))
        .withColumns(
            {
                "flat_cost_savings_inr": saved * K.FLAT_INR_PER_TRIP,
                "flat_co2_saved_kg": rnd(saved * K.FLAT_KM_PER_TRIP * K.FLAT_CO2_PER_KM, 1),
            }
        )
        .join(mixed, list(keys))
    )


def solo_costs(shipments: DataFrame, vehicle: str | None = None) -> DataFrame:
    """Cost and CO2 of sending each shipment alone.

    ``vehicle`` names the column with the type to price; without it each
    shipment gets its right-sized type.
    """
    km = rnd(road_km(*[F.col(c) for c in ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng")]), 1)
    df = shipments.withColumn("solo_km", km)
    if vehicle is None:
        df = df.withColumn("_cm3", pack_volume_cm3("length_cm", "width_cm", "height_cm"))
        df = df.withColumn("solo_vehicle", best_vehicle("weight_kg", "_cm3", "solo_km")).drop("_cm3")
        vehicle = "solo_vehicle"
    spec = {"_fix": "fixed_cost_per_trip", "_km": "cost_per_km", "_ckm": "co2_per_km_kg", "_ctk": "co2_per_ton_km"}
    return vehicle_columns(df, vehicle, spec).withColumns(
        {
            "solo_cost_inr": trip_cost(F.col("_fix"), F.col("_km"), F.col("solo_km")),
            "solo_co2_kg": co2_kg(F.col("_ckm"), F.col("_ctk"), F.col("weight_kg"), F.col("solo_km")),
        }
    ).drop(*spec)


def savings(trucks: DataFrame, shipments: DataFrame, keys=RUN, right_sized: bool = False) -> DataFrame:
    """Savings against solo dispatch.

    ``shipments``: one row per shipment on a truck with ``assigned_vehicle``.
    The solo trip is priced on the truck's own vehicle type, or on the
    shipment's right-sized type.
    """
    solo = solo_costs(shipments, None if right_sized else "assigned_vehicle").groupBy(*keys).agg(
        F.count("*").alias("solo_trips"), exact_sum("solo_cost_inr", 10_000).alias("_cost"), exact_sum("solo_co2_kg", 10_000).alias("_co2")
    )
    cons = trucks.groupBy(*keys).agg(
        F.count("*").alias("consolidated_trips"),
        exact_sum("cost_estimate_inr").alias("_ccost"), exact_sum("co2_kg_estimate").alias("_cco2"),
    )
    return savings_from_totals(solo.join(cons, list(keys)), keys)


def savings_from_totals(df: DataFrame, keys=RUN) -> DataFrame:
    """Savings measures from totals: solo_trips, consolidated_trips, _cost, _co2, _ccost, _cco2."""
    cost, co2 = F.col("_cost") - F.col("_ccost"), F.col("_co2") - F.col("_cco2")
    return df.select(
        *keys, "solo_trips", "consolidated_trips",
        (F.col("solo_trips") - F.col("consolidated_trips")).alias("trips_saved"),
        _pct(F.col("solo_trips") - F.col("consolidated_trips"), F.col("solo_trips")).alias("trip_reduction_pct"),
        rnd(F.col("_cost"), 0).alias("solo_cost_inr"), rnd(F.col("_ccost"), 0).alias("cons_cost_inr"),
        rnd(cost, 0).alias("cost_saved_inr"), _pct(cost, F.col("_cost")).alias("cost_saving_pct"),
        rnd(F.col("_co2"), 1).alias("solo_co2_kg"), rnd(F.col("_cco2"), 1).alias("cons_co2_kg"),
        rnd(co2, 1).alias("co2_saved_kg"), _pct(co2, F.col("_co2")).alias("co2_saving_pct"),
    )


def stage_counts(run, keys=RUN) -> DataFrame:
    """Groups after clustering, routing and packing, and how many were split."""
    keys = list(keys)
    shipments = run.routes.groupBy(*keys).agg(F.sum("group_size").alias("input_shipments"))
    routed = run.routes.groupBy(*keys).agg(
        F.count_if(F.col("route_no") == 0).alias("after_clustering"),
        F.count("*").alias("after_routing"),
        F.count_if((F.col("route_no") == 0) & (F.col("routes_in_group") > 1)).alias("split_by_route"),
        F.count_if("is_corridor").alias("corridor_routes"),
    )
    packed = run.trucks.groupBy(*keys).agg(
        F.count("*").alias("trucks_dispatched"),
        F.count_if("convoy").alias("convoys"),
        F.count_if(F.col("load_factor") < K.LF_FLOOR).alias("low_util"),
    )
    over = run.exceptions.groupBy(*keys).agg(F.count("*").alias("oversize"))
    return (
        shipments.join(routed, keys).join(packed, keys).join(over, keys, "left")
        .withColumn("oversize", F.coalesce("oversize", F.lit(0)))
    )


def full_report(run, shipments: DataFrame, keys=RUN) -> DataFrame:
    """One row per run with the sections of bounded size as structs and arrays.

    The lanes are as many as the data has, so they stay a table of rows beside
    the report: ``lane_efficiency``.
    """
    keys = list(keys)
    box = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    rows = lambda df, name: df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c not in keys]))).alias(name)
    )
    parts = [
        box(stage_counts(run, keys), "stages"),
        box(consolidation_summary(run.trucks, keys), "consolidation"),
        box(utilization(run.trucks, keys), "utilization"),
        rows(lf_histogram(run.trucks, keys), "distribution"),
        box(savings(run.trucks, shipments, keys), "savings"),
        rows(vehicle_mix(run.trucks, keys), "fleet"),
        rows(goods_summary(shipments, keys), "goods"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys)
    return out


# --- input reports ---------------------------------------------------------


def input_kpis(shipments: DataFrame) -> DataFrame:
    return shipments.agg(
        F.count("*").alias("shipments"),
        F.count_distinct("pickup_hub").alias("origin_hubs"),
        F.count_distinct("delivery_hub").alias("destinations"),
        rnd(exact_sum("weight_kg") / 1000.0, 1).alias("total_tonnes"),
    )


def lane_distribution(shipments: DataFrame, pickup="pickup_hub", delivery="delivery_hub") -> DataFrame:
    return shipments.groupBy(F.concat_ws(" → ", pickup, delivery).alias("lane")).agg(
        F.count("*").alias("shipments"),
        F.count_if(F.col("weight_kg") < K.LTL_BELOW_KG).alias("ltl"),
        rnd(F.count_if(F.col("weight_kg") < K.LTL_BELOW_KG) / F.count("*") * 100.0, 1).alias("ltl_pct"),
    )


def wave_distribution(shipments: DataFrame) -> DataFrame:
    hour = F.floor(F.col("earliest_s") % 86400 / 3600)
    wave = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")
    return shipments.groupBy("pickup_hub", wave.alias("wave")).agg(F.count("*").alias("shipments"))


def hub_fanout(shipments: DataFrame, pickup="pickup_hub", delivery="delivery_hub", at_least: int = 3) -> DataFrame:
    return (
        shipments.groupBy(pickup)
        .agg(F.count("*").alias("shipments"), F.count_distinct(delivery).alias("destinations"))
        .filter(F.col("shipments") >= at_least)
    )


def reach_sketches(shipments: DataFrame, keys: list[str], measures: dict[str, Column], lg_k: int = 14) -> DataFrame:
    """Per key a mergeable sketch of each measure's distinct values, of at most 2**lg_k bytes.

    Keep the rows of a period as a table: counts over any range of periods
    follow from ``merge_reach`` without another look at its shipments. The sketch
    is combined on the map side, so a hot key costs no more than another.
    """
    return shipments.groupBy(*keys).agg(*[F.hll_sketch_agg(c, lg_k).alias(name) for name, c in measures.items()])


def merge_reach(sketches: DataFrame, keys: list[str], measures: list[str], lg_k: int = 14) -> DataFrame:
    """Estimated distinct values per key over all rows of ``sketches``; keys may be fewer than those they were made by.

    The standard error is 1.04 / sqrt(2**lg_k) of the count.
    """
    return sketches.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(m, False)).alias(m) for m in measures])


def top_lanes(counts: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k largest lanes; ties by name."""
    return counts.orderBy(F.desc(by), "lane").limit(k)


def map_layer(trucks: DataFrame) -> DataFrame:
    """Map data per truck: distinct pickups and deliveries, line start and weight, colour index."""
    point = lambda s: F.array_distinct(F.transform("items", lambda x: F.struct(x[f"{s}_lat"].alias("lat"), x[f"{s}_lng"].alias("lng"))))
    df = trucks.withColumns({"pickups": point("pickup"), "deliveries": point("delivery")})
    mean = lambda f: F.expr(f"aggregate(pickups.{f}, 0D, (a, x) -> a + x) / size(pickups)")
    return df.select(
        *[c for c in ("scenario_id", "period") if c in df.columns], "truck_id", "assigned_vehicle", "group_lane", "load_factor", "group_weight_kg",
        "pickups", mean("lat").alias("pickup_lat"), mean("lng").alias("pickup_lng"),
        F.greatest(F.lit(2), F.floor(F.col("load_factor") * 6).cast("int")).alias("line_weight"),
        (F.conv(F.substring(F.md5("truck_id"), 1, 4), 16, 10).cast("int") % 15).alias("colour"),
        F.explode("deliveries").alias("d"),
    ).select("*", F.col("d.lat").alias("delivery_lat"), F.col("d.lng").alias("delivery_lng")).drop("d")
