"""Registered queries: every one reads the given tables in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import bearing_deg, bearing_diff, detour_multiplier, detour_of_legs, detour_offset, haversine_km, road_km, road_legs, zone_id
from ..functions.measures import best_vehicle, pack_volume_cm3, route_volume_cm3, truck_tags, weight_units
from ..functions.rounding import rnd
from ..operators import corridor, feasibility, learning, loading, metrics, proximity, route, vehicles, windows
from ..operators.clusters import destination_clusters, lane_sums, origin_clusters
from ..operators.places import assign_places, bucket_name
from ..operators.validate import coord_error, reject_reason, required_rows, window_seconds
from ..session import Stages
from ..sources.fleet import LARGEST, fleet_df
from ..sources.shipments import planning_rows, shipments_view
from .dispatch import Run, load_trucks, run_plan, truck_shipments
from .grouping import ITEM_FIELDS
from .params import BALANCED, PRESETS, variants
from .scenarios import compare, recommend

PAIR_KEY = ["ship_week", "pickup_hub"]
LANE = ["ship_week", "pickup_hub", "delivery_hub"]
ENDS = ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng")

_kept: dict = {}


def forget() -> None:
    """Drop the remembered runs, so that the next query plans from scratch."""
    _kept.clear()


def keep(spark: SparkSession, name: str, make):
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def ends() -> list[Column]:
    return [F.col(c) for c in ENDS]


def one_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The shipments as a stage table, for queries that pass over them more than once."""
    return Stages(spark).save(shipments_view(spark, sf), "view")


def balanced_run(spark: SparkSession, sf: str) -> Run:
    """The default run, planned once per session; its stages are tables."""
    return keep(spark, f"balanced {sf}", lambda: run_plan(spark, planning_rows(shipments_view(spark, sf)), (BALANCED,)))


def sweep_run(spark: SparkSession, sf: str) -> Run:
    return keep(spark, f"sweep {sf}", lambda: run_plan(spark, planning_rows(shipments_view(spark, sf)), PRESETS))


#: What every solo route has alike; as literals they cost no column, and Spark drops what they rule out.
SOLO = {"scenario_id": "solo", "consolidation_type": "singleton", "multi_drop": False, "bearing_limit": 45.0, "group_size": 1}


def solo_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Every shipment as a route of its own with its vehicle, written once; figures are told from the stage table.

    The vehicle is a column of that table: a filter or a join on what hangs on it
    would else repeat the comparison of all types wherever a figure names it.
    """
    rows = planning_rows(shipments_view(spark, sf)).withColumns(
        {
            "weight_u": weight_units(F.col("weight_kg")),
            "pickup_place": F.col("pickup_hub"), "delivery_place": F.col("delivery_hub"),
        }
    )
    routes = rows.select(
        "period", F.col("shipment_id").alias("route_id"), F.array(F.struct(*ITEM_FIELDS)).alias("items"),
        F.concat_ws(" → ", "pickup_place", "delivery_place").alias("group_lane"), F.col("weight_u").alias("group_u"),
    )
    alike = {c: F.lit(v) for c, v in SOLO.items()}
    chosen = vehicles.choose_vehicles(route.annotate_routes(routes.withColumns({**alike, "_as_given": F.col("items")})))
    told = chosen.withColumn("items", F.col("_as_given")).select(*routes.columns, *vehicles.CHOICE)
    stage = Stages(spark, compression="zstd").save(told, "solo_routes").withColumns(alike)
    return route.annotate_routes(stage).drop("bearing_limit")


def solo_trucks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(trucks, exceptions) of the solo routes; a query computes the columns that it reads, and no table of whole trucks is written."""
    def make() -> tuple[DataFrame, DataFrame]:
        carried, exceptions = vehicles.split_oversize(solo_routes(spark, sf))
        return load_trucks(carried), exceptions

    return keep(spark, f"solo {sf}", make)


# --- geo ------------------------------------------------------------------


def haversine(spark, sf):
    return shipments_view(spark, sf).select(
        "shipment_id", rnd(haversine_km(*ends()), 3).alias("direct_km"), rnd(road_km(*ends()), 3).alias("road_km")
    )


def bearing(spark, sf):
    return shipments_view(spark, sf).select("shipment_id", rnd(bearing_deg(*ends()), 3).alias("bearing_deg"))


def anchor_pairs(spark, sf) -> DataFrame:
    """Every shipment (b) beside the heaviest of its week and pickup hub (a): linear, not all pairs."""
    view = shipments_view(spark, sf)
    cols = {"id": "shipment_id", "plat": ENDS[0], "plng": ENDS[1], "dlat": ENDS[2], "dlng": ENDS[3], "place": "delivery_hub"}
    order = F.struct(-F.col("weight_kg"), F.col("shipment_id"))
    fields = F.struct(*[F.col(v).alias(k) for k, v in cols.items()])
    anchors = view.groupBy(*PAIR_KEY).agg(F.min_by(fields, order).alias("a"))
    return (
        view.join(anchors, PAIR_KEY)
        .filter(F.col("shipment_id") != F.col("a.id"))
        .select(*[F.col(f"a.{k}").alias(f"a_{k}") for k in cols], *[F.col(v).alias(f"b_{k}") for k, v in cols.items()])
    )


def _pt(s: str) -> dict:
    return {c: F.col(f"{s}_{c}") for c in ("plat", "plng", "dlat", "dlng")}


def bearing_diff_pairs(spark, sf):
    gap = bearing_diff(bearing_deg(*_pt("a").values()), bearing_deg(*_pt("b").values()))
    return anchor_pairs(spark, sf).select("a_id", "b_id", rnd(gap, 3).alias("bearing_gap"))


def detour_offset_pairs(spark, sf):
    return anchor_pairs(spark, sf).select("a_id", "b_id", rnd(detour_offset(_pt("a"), _pt("b")), 6).alias("detour"))


def detour_multiplier_pairs(spark, sf):
    ratio, order = detour_multiplier(_pt("a"), _pt("b"))
    return anchor_pairs(spark, sf).select("a_id", "b_id", rnd(ratio, 6).alias("detour_ratio"), order.alias("drop_order"))


def probe_points(spark, sf) -> DataFrame:
    """Points spread over and beyond the globe, derived from events."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    lat = (F.col("event_id") * 7 % 4000).cast("double") / 20.0 - 100.0
    lng = (F.col("event_id") * 13 % 8000).cast("double") / 20.0 - 200.0
    special = F.col("user_id") % 50
    return ev.select(
        "event_id",
        F.when(special == 1, None).when(special == 2, float("nan")).when(special == 3, float("inf")).otherwise(lat).alias("lat"),
        F.when(special == 4, None).when(special == 5, float("nan")).when(special == 6, float("-inf")).otherwise(lng).alias("lng"),
    )


def coord_verdict(spark, sf):
    return probe_points(spark, sf).select("event_id", F.coalesce(coord_error("lat", "lng"), F.lit("ok")).alias("verdict"))


def coord_bucket(spark, sf):
    return shipments_view(spark, sf).select(
        "shipment_id", bucket_name(*ENDS[:2]).alias("pickup_bucket"), bucket_name(*ENDS[2:]).alias("delivery_bucket")
    )


def bbox_place(spark, sf):
    return assign_places(shipments_view(spark, sf)).select(
        "shipment_id", "pickup_place", "pickup_source", "delivery_place", "delivery_source", "lane", "degraded_place"
    )


def grid_zone(spark, sf):
    lat, lng = F.col("pickup_lat"), F.col("pickup_lng")
    return shipments_view(spark, sf).select("shipment_id", *[zone_id(lat, lng, r).alias(f"zone_r{r}") for r in (6, 7, 8, 9, 10)])


def box_volume(spark, sf):
    # a side equal to another one is blanked, so that missing sides occur
    l = F.nullif(F.col("length_cm"), F.col("width_cm"))
    h = F.nullif(F.col("height_cm"), F.col("width_cm"))
    return shipments_view(spark, sf).select(
        "shipment_id", route_volume_cm3(l, "width_cm", h).alias("route_cm3"), pack_volume_cm3(l, "width_cm", h).alias("pack_cm3")
    )


# --- filters --------------------------------------------------------------


def raw_feed(spark, sf) -> DataFrame:
    """Shipments as a text feed with blanks and damaged times, derived from the tables."""
    view = shipments_view(spark, sf)
    def stamp(m):
        clock = F.format_string("%02d:%02d:00", F.floor(F.col(m) / 60), F.col(m) % 60)
        return F.concat(F.col("ship_week").cast("string"), F.lit("T"), clock)

    swapped = F.col("width_cm") % 41 == 0
    return view.select(
        "shipment_id", F.when(F.col("length_cm") % 50 != 0, F.col("pickup_lat")).alias("pickup_lat"), "pickup_lng",
        "delivery_lat", "delivery_lng",
        F.when(F.col("height_cm") % 31 == 0, float("nan")).otherwise(F.col("weight_kg")).alias("weight_kg"),
        F.when(swapped, stamp("latest_min")).when(F.col("length_cm") % 37 == 0, "soon").otherwise(stamp("earliest_min")).alias("earliest_delivery"),
        F.when(swapped, stamp("earliest_min")).otherwise(stamp("latest_min")).alias("latest_delivery"),
    )


def required(spark, sf):
    return required_rows(raw_feed(spark, sf)).select("shipment_id", "weight_kg", "earliest_delivery")


def window_validity(spark, sf):
    df = window_seconds(raw_feed(spark, sf))
    return df.select("shipment_id", F.coalesce(reject_reason(df), F.lit("ok")).alias("verdict"))


def route_compat_pairs(spark, sf):
    return corridor.route_compatibility(anchor_pairs(spark, sf)).select(
        "a_id", "b_id", F.coalesce("reason", F.lit("incompatible")).alias("reason"), "compatible",
        (F.col("compatible") & F.col("needs_review")).alias("review"),
    )


def travel_compat_pairs(spark, sf):
    return route.travel_compatibility(anchor_pairs(spark, sf)).select(
        "a_id", "b_id", rnd(F.col("bearing_gap"), 3).alias("bearing_gap"), rnd(F.col("detour_ratio"), 6).alias("detour_ratio"),
        "drop_order", "verdict",
    )


# --- joins ----------------------------------------------------------------


def lane_singles(spark, sf) -> DataFrame:
    """Shipments that the window grouping leaves alone on their lane and week."""
    view = one_scan(spark, sf).withColumns(
        {"earliest_s": F.col("earliest_min").cast("long") * 60, "latest_s": F.col("latest_min").cast("long") * 60}
    )
    # every shipment is a window of its own: they are added up per start on the map side, once
    each = {"n": F.lit(1).cast("long"), "u": F.lit(0).cast("long"), "min_overlap_s": F.lit(1800).cast("long")}
    borders = windows.window_groups(view.withColumns(each), LANE)
    lone = borders.filter("group_n = 1").select(*LANE, "earliest_s")
    return view.join(lone, [*LANE, "earliest_s"]).drop("earliest_s", "latest_s")


def corridor_candidates(spark, sf):
    """Candidate pairs among lone shipments of one week and pickup hub.

    A hub has at most one lone shipment per destination and window group; they
    meet in the hours that their windows share.
    """
    cols = {"id": "shipment_id", "plat": ENDS[0], "plng": ENDS[1], "dlat": ENDS[2], "dlng": ENDS[3], "place": "delivery_hub", "kg": "weight_kg", "e": "earliest_min", "t": "latest_min"}
    singles = lane_singles(spark, sf).select(*PAIR_KEY, *[F.col(v).alias(k) for k, v in cols.items()])
    return corridor.route_compatibility(corridor.candidate_pairs(singles, PAIR_KEY)).filter("compatible").select(
        "a_id", "b_id", "reason", "needs_review", "overlap_min", (F.col("a_kg") + F.col("b_kg")).alias("combined_kg")
    )


def place_pairs_within_radius(spark, sf):
    placed = assign_places(shipments_view(spark, sf))
    sums = lane_sums(placed, ["pickup_place"])
    points = sums.select(
        F.col("pickup_place").alias("place"),
        (F.col("plat") / F.col("n") / 1e6).alias("lat"), (F.col("plng") / F.col("n") / 1e6).alias("lng"),
    )
    return proximity.pairs_within(points, 50.0).select("a", "b", rnd(F.col("km"), 3).alias("km"))


def lane_overlap_partners(spark, sf):
    rows = planning_rows(one_scan(spark, sf))
    return proximity.overlap_partners(rows, ["period", "pickup_hub", "delivery_hub"]).select(
        "shipment_id", "lane_mates", "overlapping", (F.col("lane_mates") - F.col("overlapping")).alias("apart")
    )


def flagged_singles(spark, sf) -> DataFrame:
    return proximity.missed_partners(lane_singles(spark, sf), ["ship_week"])


def missed_singletons(spark, sf):
    return flagged_singles(spark, sf).filter("missed").select("shipment_id")


def unavoidable_singletons(spark, sf):
    return flagged_singles(spark, sf).filter("NOT missed").select("shipment_id")


def singleton_share(spark, sf):
    return proximity.missed_share(flagged_singles(spark, sf))


def vehicle_fit(spark, sf):
    # every seventh box size eight times as large, so that some exceed every hold
    scale = F.when(F.col("length_cm") % 7 == 0, F.lit(8.0)).otherwise(F.lit(1.0))
    df = shipments_view(spark, sf).withColumn("cm3", pack_volume_cm3("length_cm", "width_cm", "height_cm") * scale)
    df = df.withColumn("fits", vehicles.fitting_vehicles("weight_kg", "cm3"))
    return df.select("shipment_id", F.size("fits").alias("n_fits"), F.array_join("fits", ";").alias("vehicles"))


# --- vehicles and solo trucks ---------------------------------------------


def best_vehicle_query(spark, sf):
    volume = pack_volume_cm3("length_cm", "width_cm", "height_cm")
    df = shipments_view(spark, sf).withColumns({"km": rnd(road_km(*ends()), 1), "cm3": volume})
    choice = best_vehicle("weight_kg", "cm3", "km")
    return df.select("shipment_id", F.coalesce(choice, F.lit("OVERSIZE")).alias("vehicle"))


def solo_manifest(spark, sf):
    df = vehicles.manifest(solo_trucks(spark, sf)[0])
    return df.drop("scenario_id", "convoy_position", "n_shipments").withColumnRenamed("truck_id", "shipment_id").drop("shipment_ids")


def oversize_exceptions(spark, sf):
    return solo_trucks(spark, sf)[1].select("shipment_id", "period", "weight_kg", "oversize", "assigned_vehicle")


def vehicle_numbers(spark, sf):
    trucks = solo_trucks(spark, sf)[0].select("scenario_id", "period", "truck_id", "assigned_vehicle")
    return vehicles.vehicle_numbers(trucks).select("truck_id", "assigned_vehicle", "assigned_vehicle_no")


def pool_status(spark, sf):
    return vehicles.pool_status(solo_trucks(spark, sf)[0]).select("period", "name", "total", "busy", "available")


def stop_list(spark, sf):
    return route.stop_list(solo_trucks(spark, sf)[0])


def truck_flags(spark, sf):
    t = solo_trucks(spark, sf)[0]
    lf = F.col("load_factor")
    return t.select(
        "truck_id", metrics.lf_band(lf).alias("band"),
        F.array_join(truck_tags(F.col("convoy"), F.col("axle_balance_ok"), F.col("group_size"), lf), ",").alias("tags"),
        (lf < 0.45).alias("defer"),
    )


# --- aggregates -----------------------------------------------------------


def lane_centroids(spark, sf):
    s = lane_sums(shipments_view(spark, sf), LANE)
    c = {k: F.col(k) / F.col("n") / 1e6 for k in ("plat", "plng", "dlat", "dlng")}
    return s.select(*LANE, "n", *[rnd(v, 6).alias(k) for k, v in c.items()], rnd(bearing_deg(*c.values()), 3).alias("corridor_bearing"))


def lane_facts(view: DataFrame, stages: Stages) -> DataFrame:
    """Corridor bearing and anchor, the heaviest shipment, of every lane.

    Numbers alone are summed over all rows, which Spark does by hash; a struct
    with an id among them would sort every row first. Only the rows of the
    lane's largest weight are then compared by id. A shipment of unknown weight comes first.
    """
    c = [F.col(k) / F.col("n") / 1e6 for k in ("plat", "plng", "dlat", "dlng")]
    neg = -F.col("weight_kg")
    sums = lane_sums(view, LANE, F.min(neg).alias("neg"), F.bool_or(F.col("weight_kg").isNull()).alias("unknown"))
    # as a stage table the lanes have a known size, so that rows meet them without a shuffle while they are few
    sums = stages.save(sums.select(*LANE, bearing_deg(*c).alias("corridor"), "neg", "unknown"), "lane_sums")
    named = F.struct(F.col("shipment_id").alias("id"), *[F.col(x).alias(y) for x, y in zip(ENDS, ("plat", "plng", "dlat", "dlng"))])
    heaviest = F.when(F.col("unknown"), F.col("weight_kg").isNull()).otherwise(neg == F.col("neg"))
    first = view.join(sums.select(*LANE, "neg", "unknown"), LANE).filter(heaviest)
    anchors = first.groupBy(*LANE).agg(F.min_by(named, F.struct("shipment_id")).alias("a"))
    return stages.save(sums.join(anchors, LANE).select(*LANE, "corridor", "a"), "lane_facts")


def lane_route_stats(spark, sf):
    """Bearing spread, worst detour against the heaviest and distances per week and lane."""
    stages = Stages(spark)
    view = stages.save(shipments_view(spark, sf).select(*LANE, "shipment_id", "weight_kg", *ENDS), "view")
    a = {k: F.col(f"a.{k}") for k in ("plat", "plng", "dlat", "dlng")}
    b = dict(zip(("plat", "plng", "dlat", "dlng"), ends()))
    # distances and bearings are columns before they are used, each worked out once a row
    legs = dict(zip(("to_anchor", "to_rider", "between"), road_legs(a, b)))
    rows = view.join(lane_facts(view, stages), LANE).withColumns(
        {**legs, "km": road_km(*ends()), "bearing": bearing_deg(*ends()), "rides": F.col("shipment_id") != F.col("a.id")}
    )
    rows = rows.withColumn("gap", bearing_diff(F.col("bearing"), F.col("corridor")))
    ratio = F.when(F.col("rides"), detour_of_legs(*[F.col(x) for x in legs])[0])
    gap, km = F.col("gap"), F.col("km")
    return rows.groupBy(*LANE).agg(
        F.count("*").alias("n"),
        rnd(F.sqrt(F.avg(gap * gap)), 3).alias("bearing_spread"),
        rnd(F.coalesce(F.max(ratio), F.lit(1.0)), 4).alias("max_detour_ratio"),
        rnd(F.sum(km), 2).alias("total_road_km"), rnd(F.avg(km), 2).alias("avg_road_km"),
        ((F.count("*") >= 3) & (F.max(rnd(gap, 9)) <= 45.0)).alias("is_corridor"),
    )


def _solo_metric(fn, *drop):
    return lambda spark, sf: fn(solo_trucks(spark, sf)[0]).drop(*drop)


def goods_summary(spark, sf):
    return metrics.goods_summary(shipments_view(spark, sf))


def input_kpis(spark, sf):
    return metrics.input_kpis(shipments_view(spark, sf))


def lane_distribution(spark, sf):
    return metrics.lane_distribution(shipments_view(spark, sf))


def top_lanes(spark, sf):
    return metrics.top_lanes(metrics.lane_distribution(shipments_view(spark, sf)), "shipments")


def hub_fanout(spark, sf):
    return metrics.hub_fanout(shipments_view(spark, sf))


def wave_distribution(spark, sf):
    return metrics.wave_distribution(planning_rows(shipments_view(spark, sf)))


def solo_savings(spark, sf):
    """Right-sized solo dispatch against one largest truck per shipment."""
    trucks = solo_trucks(spark, sf)[0]
    rows = truck_shipments(trucks).withColumn("assigned_vehicle", F.lit(LARGEST.name))
    return metrics.savings(trucks, rows).drop("scenario_id")


# --- ordering and windows -------------------------------------------------


def heaviest_anchor(spark, sf):
    v = shipments_view(spark, sf)
    return v.groupBy(*PAIR_KEY).agg(
        F.min_by("shipment_id", F.struct(-F.col("weight_kg"), "shipment_id")).alias("anchor_id"),
        F.max("weight_kg").alias("anchor_kg"),
        F.min_by("shipment_id", F.struct("latest_min", "shipment_id")).alias("first_deadline_id"),
    )


def overlap_islands(spark, sf):
    rows = planning_rows(shipments_view(spark, sf)).withColumn("right", F.col("latest_s") - 1800)
    keys = ["period", "pickup_hub", "delivery_hub"]
    starts = rows.groupBy(*keys, "earliest_s").agg(F.max("right").alias("right"), F.count("*").alias("n"))
    cut = windows.add_islands(starts, keys, "earliest_s", "right", ["earliest_s"])
    return cut.groupBy(*keys, "island").agg(
        F.sum("n").alias("shipments"), F.min("earliest_s").alias("from_s"), F.max("right").alias("to_s")
    )


def window_groups(spark, sf):
    keys = ["period", "pickup_hub", "delivery_hub"]
    rows = planning_rows(shipments_view(spark, sf)).withColumn("u", weight_units(F.col("weight_kg")))
    spans = rows.groupBy(*keys, "earliest_s", "latest_s").agg(F.count("*").alias("n"), F.sum("u").alias("u"))
    spans = Stages(spark).save(spans, "spans").withColumn("min_overlap_s", F.lit(1800).cast("long"))
    borders = windows.window_groups(spans, keys)
    return spans.join(borders.select(*keys, "earliest_s", "window_no"), [*keys, "earliest_s"]).groupBy(*keys, "window_no").agg(
        F.min("earliest_s").alias("first_start_s"), F.sum("n").alias("shipments"), (F.sum("u") / float(K.WEIGHT_UNITS_PER_KG)).alias("weight_kg"),
        (F.min("latest_s") - F.max("earliest_s")).alias("common_s"),
    ).drop("window_no")


# --- learning and feasibility ---------------------------------------------


def solo_samples(spark, sf) -> DataFrame:
    return learning.zone_samples(truck_shipments(solo_trucks(spark, sf)[0]))


def zone_samples(spark, sf):
    return solo_samples(spark, sf).select("zone_id", "run", rnd(F.col("sample_lf"), 6).alias("sample_lf"), "shipments")


def zone_state(spark, sf) -> DataFrame:
    return learning.fold_runs(solo_samples(spark, sf))


def zone_ema(spark, sf):
    log = F.col("adjustment_log")
    last = F.try_element_at(log, F.lit(-1))
    return zone_state(spark, sf).select(
        "zone_id", "resolution", "run_count", "avg_load_factor", "last_load_factor", "last_run",
        F.size(log).alias("adjustments"), last["run"].alias("adjusted_run"), last["reason"].alias("reason"),
    )


def zone_summary(spark, sf):
    return learning.zone_summary(zone_state(spark, sf))


def resolution_histogram(spark, sf):
    return learning.resolution_histogram(zone_state(spark, sf))


def improved_zones(spark, sf):
    return learning.improved_zones(zone_state(spark, sf))


def zone_lookup(spark, sf):
    """Zones of all deliveries looked up among the zones learned from pickups."""
    v = shipments_view(spark, sf).select(F.col("delivery_lat").alias("pickup_lat"), F.col("delivery_lng").alias("pickup_lng"))
    return learning.zone_resolutions(v, zone_state(spark, sf))


def solo_features(spark, sf) -> DataFrame:
    return feasibility.feature_table(solo_trucks(spark, sf)[0])


def feature_rows(spark, sf):
    f = feasibility.with_labels(solo_features(spark, sf))
    return f.select("truck_id", *[rnd(F.col(c), 4).alias(c) for c in feasibility.FEATURES], "label")


def rule_score(spark, sf):
    return feasibility.with_rule_score(solo_features(spark, sf)).select("truck_id", "feasibility_score")


def rule_explanation(spark, sf):
    return feasibility.with_reason(feasibility.with_rule_score(solo_features(spark, sf))).select("truck_id", "feasibility_reason")


def feasibility_bands(spark, sf):
    return feasibility.score_bands(feasibility.with_rule_score(solo_features(spark, sf)))


def map_layer(spark, sf):
    m = metrics.map_layer(solo_trucks(spark, sf)[0])
    return m.select(
        "truck_id", "assigned_vehicle", "group_lane", rnd(F.col("pickup_lat"), 6).alias("pickup_lat"),
        rnd(F.col("pickup_lng"), 6).alias("pickup_lng"), rnd(F.col("delivery_lat"), 6).alias("delivery_lat"),
        rnd(F.col("delivery_lng"), 6).alias("delivery_lng"), "line_weight", "colour",
    )


# --- the planning run -----------------------------------------------------


def _lane_table(spark, sf) -> DataFrame:
    placed = assign_places(planning_rows(shipments_view(spark, sf)))
    return lane_sums(placed, ["period", "pickup_place", "delivery_place"])


def origin_cluster_query(spark, sf):
    return origin_clusters(_lane_table(spark, sf), (BALANCED,))


def destination_cluster_query(spark, sf):
    lanes = _lane_table(spark, sf)
    return destination_clusters(lanes, origin_clusters(lanes, (BALANCED,)), (BALANCED,))


def corridor_groups(spark, sf):
    g = balanced_run(spark, sf).grouping.groups.filter("multi_drop")
    return g.select("group_id", "corridor_reason", "hitl_reviewed", "cluster_n", "cluster_lane", F.array_join("items.shipment_id", ",").alias("shipment_ids"))


def split_overweight(spark, sf):
    u = balanced_run(spark, sf).grouping.units.filter(F.col("group_n") > F.col("n"))
    kg = F.expr("aggregate(items.weight_kg, 0D, (a, x) -> a + x)")
    return u.select("unit_id", "group_n", "n", kg.alias("weight_kg"))


def second_pass(spark, sf):
    return balanced_run(spark, sf).grouping.unit_map.filter("NOT multi_drop").select("unit_id", "group_id")


def clustered_groups(spark, sf):
    groups = balanced_run(spark, sf).grouping.groups.select(
        "group_id", "period", "cluster_type", "cluster_lane", "cluster_n", "cluster_weight_kg"
    )
    return metrics.listing(groups, "groups")


def route_listing(spark, sf):
    kg = F.expr("aggregate(items.weight_u, 0L, (a, x) -> a + x)") / float(K.WEIGHT_UNITS_PER_KG)
    routes = balanced_run(spark, sf).routes.select("route_id", "group_lane", "consolidation_type", "group_size", kg.alias("weight_kg"))
    return metrics.listing(routes, "routes")


def truck_listing(spark, sf):
    trucks = solo_trucks(spark, sf)[0].select("truck_id", "assigned_vehicle", "load_factor", "group_weight_kg")
    return metrics.listing(trucks, "trucks")


def travel_split(spark, sf):
    return balanced_run(spark, sf).routes.filter("routes_in_group > 1").select(
        "group_id", "route_id", "group_size", "consolidation_type", "group_lane", "is_corridor", "vol_utilisation"
    )


def stop_sequence(spark, sf):
    r = balanced_run(spark, sf).routes
    return r.select("route_id", F.posexplode("stop_sequence").alias("pos", "shipment_id")).select(
        "route_id", (F.col("pos") + 1).alias("stop_position"), "shipment_id"
    )


def route_stats(spark, sf):
    return route.route_stats(balanced_run(spark, sf).routes).select(
        "route_id", "avg_bearing", "bearing_spread", "max_detour_ratio", "total_road_km", "avg_road_km", "is_corridor", "vol_utilisation"
    )


def load_plan(spark, sf):
    t = balanced_run(spark, sf).trucks
    return t.select("truck_id", "assigned_vehicle", F.explode("load").alias("b")).select("truck_id", "assigned_vehicle", "b.*")


def axle_report(spark, sf):
    return balanced_run(spark, sf).trucks.select("truck_id", "axle_balance_ok", rnd(F.col("axle_front_pct"), 3).alias("axle_front_pct"), rnd(F.col("axle_rear_pct"), 3).alias("axle_rear_pct"))


def convoy(spark, sf):
    """Convoys for the weekly demand of a lane where it exceeds the largest truck."""
    rows = shipments_view(spark, sf).withColumns(
        {"weight_u": weight_units(F.col("weight_kg")), "earliest_s": F.col("earliest_min").cast("long") * 60}
    )
    c = loading.convoys(rows, LANE)
    return c.select(*LANE, "convoy_truck_num", "convoy_truck_count", F.size("items").alias("shipments"), "weight_kg")


def dispatch_manifest(spark, sf):
    """Lines are told before trucks are numbered, so that no items are dealt out."""
    lines = vehicles.manifest(balanced_run(spark, sf).trucks)
    numbered = vehicles.vehicle_numbers(lines.withColumn("assigned_vehicle", F.col("vehicle_name")))
    return metrics.listing(numbered.select(*lines.columns, "assigned_vehicle_no"), "manifest")


def run_savings(spark, sf):
    t = balanced_run(spark, sf).trucks
    return metrics.savings(t, truck_shipments(t)).unionByName(
        metrics.savings(t, truck_shipments(t), right_sized=True).withColumn("scenario_id", F.lit("balanced, right-sized solo"))
    )


def flat_metrics(spark, sf):
    run = balanced_run(spark, sf)
    return metrics.flat_metrics(run.trucks, run.exceptions)


def stage_counts(spark, sf):
    return metrics.stage_counts(balanced_run(spark, sf))


def run_report(spark, sf):
    run = balanced_run(spark, sf)
    df = metrics.full_report(run, truck_shipments(run.trucks))
    return df.select("scenario_id", *[F.to_json(c).alias(c) for c in df.columns if c != "scenario_id"])


def run_report_lanes(spark, sf):
    """The report's lane section: every lane of the run, largest first."""
    lanes = metrics.lane_efficiency(balanced_run(spark, sf).trucks)
    return lanes.orderBy("scenario_id", F.desc("shipments"), "lane")


def feature_table(spark, sf):
    return feasibility.with_labels(feasibility.feature_table(balanced_run(spark, sf).trucks))


def gbt_scores(spark, sf):
    """Boosted trees trained on the run's own outcomes, scored on its trucks."""
    features = Stages(spark).save(feasibility.feature_table(balanced_run(spark, sf).trucks), "features")
    model = feasibility.retrain(features)
    return feasibility.score(features, model).select("truck_id", "n_shipments", "load_factor", "feasibility_score", "feasibility_reason")


def run_zone_state(spark, sf):
    t = truck_shipments(balanced_run(spark, sf).trucks)
    return learning.record_run(t).drop("adjustment_log")


def scenario_comparison(spark, sf):
    return recommend(compare(sweep_run(spark, sf)))


#: A user's sweep of the route limits: one clustering, six splits into routes.
ROUTE_LIMITS = variants(BALANCED, route_detour=(1.1, 1.25, 1.4), max_bearing_diff=(30.0, 45.0))


def route_limit_sweep(spark, sf):
    """The default scenario under several route limits; clusters, windows and groups are planned once for all."""
    return recommend(compare(run_plan(spark, planning_rows(shipments_view(spark, sf)), ROUTE_LIMITS)))


def reach_by_quarter(spark, sf):
    """Destinations, delivery points and shipments a hub reaches in a quarter: exact, and from weekly sketches within four standard errors."""
    lg_k = 14
    quarter = F.concat_ws("-", F.year("ship_week"), F.quarter("ship_week"))
    measures = {
        "destinations": F.col("delivery_hub"),
        "delivery_points": F.concat_ws(" ", *[F.round(F.col(c) * 1000).cast("long") for c in ("delivery_lat", "delivery_lng")]),
        "shipments": F.col("shipment_id"),
    }
    rows = shipments_view(spark, sf).withColumns({"quarter": quarter, **{f"_{m}": c for m, c in measures.items()}})
    keys = ["pickup_hub", "quarter"]
    weekly = metrics.reach_sketches(rows, [*keys, "ship_week"], {m: F.col(f"_{m}") for m in measures}, lg_k)
    told = metrics.merge_reach(weekly, keys, list(measures), lg_k).select(*keys, *[F.col(m).alias(f"told_{m}") for m in measures])
    exact = rows.groupBy(*keys).agg(*[F.count_distinct(f"_{m}").alias(m) for m in measures])
    bound = lambda m: F.greatest(F.lit(0.5), F.col(m) * (4 * 1.04 / 2 ** (lg_k / 2)))
    return exact.join(told, keys).select(
        *keys, *measures, *[(F.abs(F.col(f"told_{m}") - F.col(m)) <= bound(m)).alias(f"{m}_told") for m in measures]
    )


QUERIES = {
    "haversine": haversine,
    "bearing": bearing,
    "bearing_diff_pairs": bearing_diff_pairs,
    "detour_offset_pairs": detour_offset_pairs,
    "detour_multiplier_pairs": detour_multiplier_pairs,
    "coord_verdict": coord_verdict,
    "coord_bucket": coord_bucket,
    "bbox_place": bbox_place,
    "grid_zone": grid_zone,
    "box_volume": box_volume,
    "required_rows": required,
    "window_validity": window_validity,
    "route_compat_pairs": route_compat_pairs,
    "travel_compat_pairs": travel_compat_pairs,
    "corridor_candidates": corridor_candidates,
    "place_pairs_within_radius": place_pairs_within_radius,
    "lane_overlap_partners": lane_overlap_partners,
    "missed_singletons": missed_singletons,
    "unavoidable_singletons": unavoidable_singletons,
    "singleton_share": singleton_share,
    "vehicle_fit": vehicle_fit,
    "best_vehicle": best_vehicle_query,
    "solo_manifest": solo_manifest,
    "oversize_exceptions": oversize_exceptions,
    "vehicle_numbers": vehicle_numbers,
    "pool_status": pool_status,
    "stop_list": stop_list,
    "truck_flags": truck_flags,
    "lane_centroids": lane_centroids,
    "lane_route_stats": lane_route_stats,
    "utilization": _solo_metric(metrics.utilization, "scenario_id"),
    "vehicle_mix": _solo_metric(metrics.vehicle_mix, "scenario_id"),
    "lane_efficiency": _solo_metric(metrics.lane_efficiency, "scenario_id"),
    "lf_histogram": _solo_metric(metrics.lf_histogram, "scenario_id"),
    "lf_bands": _solo_metric(metrics.lf_bands, "scenario_id"),
    "consolidation_summary": _solo_metric(metrics.consolidation_summary, "scenario_id"),
    "goods_summary": goods_summary,
    "input_kpis": input_kpis,
    "reach_by_quarter": reach_by_quarter,
    "lane_distribution": lane_distribution,
    "top_lanes": top_lanes,
    "hub_fanout": hub_fanout,
    "wave_distribution": wave_distribution,
    "solo_savings": solo_savings,
    "heaviest_anchor": heaviest_anchor,
    "overlap_islands": overlap_islands,
    "window_groups": window_groups,
    "zone_samples": zone_samples,
    "zone_ema": zone_ema,
    "zone_summary": zone_summary,
    "resolution_histogram": resolution_histogram,
    "improved_zones": improved_zones,
    "zone_lookup": zone_lookup,
    "solo_features": feature_rows,
    "rule_score": rule_score,
    "rule_explanation": rule_explanation,
    "feasibility_bands": feasibility_bands,
    "map_layer": map_layer,
    "origin_clusters": origin_cluster_query,
    "destination_clusters": destination_cluster_query,
    "clustered_groups": clustered_groups,
    "route_listing": route_listing,
    "truck_listing": truck_listing,
    "corridor_groups": corridor_groups,
    "split_overweight": split_overweight,
    "second_pass": second_pass,
    "travel_split": travel_split,
    "stop_sequence": stop_sequence,
    "route_stats": route_stats,
    "load_plan": load_plan,
    "axle_report": axle_report,
    "convoy": convoy,
    "dispatch_manifest": dispatch_manifest,
    "run_savings": run_savings,
    "flat_metrics": flat_metrics,
    "stage_counts": stage_counts,
    "run_report": run_report,
    "run_report_lanes": run_report_lanes,
    "feature_table": feature_table,
    "gbt_scores": gbt_scores,
    "run_zone_state": run_zone_state,
    "scenario_comparison": scenario_comparison,
    "route_limit_sweep": route_limit_sweep,
}
