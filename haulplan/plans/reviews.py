"""Queries over reviews, custom scenarios, mixed trucks and zone histories, with their SQL.

Their inputs are derived from the shipments: decisions from candidate pairs, two
phases of runs from solo trucks, mixed groups from neighbours in the weight order
of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import weight_units
from ..functions.rounding import rnd
from ..operators import corridor, learning, metrics, route, vehicles
from ..session import Stages
from ..sources.shipments import planning_rows, shipments_view
from .grouping import annotate
from .oracles import AE, BE, CANDIDATES, OFFSET, PAIRS, RATIO, REVIEW, SHIP, ZONES, bear, gap, hav, legs, road
from .oracles import rnd as sql_rnd
from .pairs import TRUCKS, pair_trucks
from .params import Scenario, custom_scenario
from .queries import anchor_pairs, corridor_candidates, keep, solo_samples

#: A user's own scenario: shorter detours, wider bearings, nearer deliveries.
CUSTOM = custom_scenario(40.0, 30.0, 45, 1.12, 60.0, "Short detours")


# --- review decisions (J8) ---------------------------------------------------


def candidates(spark, sf) -> DataFrame:
    return keep(spark, f"candidates {sf}", lambda: Stages(spark).save(corridor_candidates(spark, sf), "candidates"))


def decisions(spark, sf) -> DataFrame:
    """One decision per candidate pair that needs a review: pairs of long windows are approved, some are left open."""
    pairs = candidates(spark, sf).filter("needs_review")
    kind = F.col("overlap_min") % 3
    return pairs.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.when(kind == 0, True).when(kind == 1, False).alias("approved"))


def refused_partners(spark, sf):
    refused = corridor.refused_partners(decisions(spark, sf))
    return refused.select("shipment_id", F.array_join(F.array_sort("refused"), ",").alias("refused"))


def open_candidates(spark, sf):
    """Candidates that a planner may still use: reviewed pairs that were refused are gone."""
    no = decisions(spark, sf).filter(~F.coalesce("approved", F.lit(True))).select(F.col("id_a").alias("a_id"), F.col("id_b").alias("b_id"))
    return candidates(spark, sf).join(no, ["a_id", "b_id"], "left_anti").select("a_id", "b_id", "reason", "needs_review")


# --- custom scenario (X2) ----------------------------------------------------


def _under(pairs: DataFrame, scenario: Scenario) -> DataFrame:
    travel = route.travel_compatibility(pairs, scenario.max_bearing_diff, scenario.route_detour)
    return corridor.route_compatibility(travel.drop("compatible"), scenario.delivery_cluster_km, scenario.clustering_detour)


def custom_compatibility(spark, sf):
    """Anchor pairs judged by a user's own scenario: by travel and by clustering."""
    judged = _under(anchor_pairs(spark, sf), CUSTOM)
    kind = F.when(F.col("reason").startswith("dest"), "dest_cluster").when(F.col("reason").startswith("corridor"), "corridor")
    return judged.select(
        F.lit(CUSTOM.scenario_id).alias("scenario_id"), F.lit(CUSTOM.label).alias("label"), "a_id", "b_id", "verdict",
        F.when(F.col("reason") == "exact_lane", "exact_lane").otherwise(F.coalesce(kind, F.lit("none"))).alias("clustering"),
    )


# --- labels of mixed groups, map of shared trucks (P12, P18, X4) -----------------------


def mixed_groups(shipments: DataFrame) -> DataFrame:
    """Neighbours by weight within a week and hub, two a group, whatever their destinations."""
    keys = ["period", "pickup_hub"]
    rows = shipments.withColumn("lighter", -weight_units(F.col("weight_kg")))
    placed = vehicles.ranked(rows, keys, "shipment_id", "place", ("lighter",)).withColumn("slot", F.floor((F.col("place") - 1) / 2))
    item = F.struct("place", "shipment_id", F.col("pickup_hub").alias("pickup_place"), F.col("delivery_hub").alias("delivery_place"), "weight_kg")
    groups = placed.groupBy(*keys, "slot").agg(F.sort_array(F.collect_list(item)).alias("items"))
    several = F.size(F.array_distinct("items.delivery_place")) > 1
    return annotate(groups.withColumn("multi_drop", several))


def mixed_labels(spark, sf):
    g = mixed_groups(planning_rows(shipments_view(spark, sf)))
    return g.select("period", "pickup_hub", "slot", "cluster_n", rnd(F.col("cluster_weight_kg"), 2).alias("cluster_weight_kg"), "cluster_type", "cluster_lane")


def pair_map(spark, sf):
    m = metrics.map_layer(pair_trucks(spark, sf))
    return m.select(
        "truck_id", "assigned_vehicle", "group_lane", F.size("pickups").alias("pickups"), rnd(F.col("pickup_lat"), 6).alias("pickup_lat"),
        rnd(F.col("pickup_lng"), 6).alias("pickup_lng"), rnd(F.col("delivery_lat"), 6).alias("delivery_lat"),
        rnd(F.col("delivery_lng"), 6).alias("delivery_lng"), "colour",
    )


# --- zone histories (A21, L4, L5) ---------------------------------------------


def improving_state(spark, sf) -> DataFrame:
    """Zones over two phases: solo trucks first, then the same runs with fuller trucks."""
    samples = solo_samples(spark, sf).select("zone_id", "run", "sample_lf")
    fuller = samples.select("zone_id", F.concat(F.lit("z"), "run").alias("run"), F.least(F.col("sample_lf") + 0.35, F.lit(1.0)).alias("sample_lf"))
    return learning.fold_runs(fuller, learning.fold_runs(samples))


def zones_improving(spark, sf):
    return learning.improved_zones(improving_state(spark, sf))


def zones_reset(spark, sf):
    """The state after a planner resets the first zone."""
    state = improving_state(spark, sf)
    first = state.agg(F.min("zone_id")).first()[0]
    return learning.reset_zones(state, first).drop("adjustment_log")


def zone_log(spark, sf):
    """The history of the zone with the most adjustments."""
    state = improving_state(spark, sf)
    most = state.orderBy(F.desc(F.size("adjustment_log")), "zone_id").select("zone_id").first()
    history = learning.zone_history(state, most[0] if most else "")
    return history.select("zone_id", "run_count", "avg_load_factor", F.explode("adjustment_log").alias("x")).select(
        "zone_id", "run_count", "avg_load_factor", "x.run", F.col("x.from").alias("from_resolution"), F.col("x.to").alias("to_resolution"), "x.reason"
    )


QUERIES = {
    "refused_partners": refused_partners,
    "open_candidates": open_candidates,
    "custom_compatibility": custom_compatibility,
    "mixed_labels": mixed_labels,
    "pair_map": pair_map,
    "zones_improving": zones_improving,
    "zones_reset": zones_reset,
    "zone_log": zone_log,
}

# --- the same in SQL -----------------------------------------------------------

_TOLD = CANDIDATES + f", told AS MATERIALIZED (SELECT *, {REVIEW} AS review FROM candidate)"
_NO = "review AND overlap_min % 3 = 1"
_MIXED = SHIP + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY period, pickup_hub ORDER BY weight_kg DESC, substr(md5(shipment_id), 1, 3), shipment_id) AS place FROM ship),
slotted AS (SELECT *, (place - 1) // 2 AS slot FROM placed)"""
_WARM = "(SELECT zone_id, run, sample_lf FROM samples UNION ALL SELECT zone_id, 'z' || run, least(sample_lf + 35e-2, 1e0) FROM samples)"
# every adjustment leaves a row, so that histories can be read off the fold
_IMPROVING = ZONES.replace("ORDER BY run) AS rn FROM samples)", f"ORDER BY run) AS rn FROM {_WARM})")
_BEFORE = "CAST(lag(resolution) OVER (PARTITION BY zone_id ORDER BY rn) AS INT)"

ORACLES = {
    "refused_partners": f"""WITH {_TOLD}, both_ways AS (SELECT a_id AS shipment_id, b_id AS other FROM told WHERE {_NO} UNION SELECT b_id, a_id FROM told WHERE {_NO})
SELECT shipment_id, string_agg(other, ',' ORDER BY other) AS refused FROM both_ways GROUP BY shipment_id""",
    "open_candidates": f"WITH {_TOLD} SELECT a_id, b_id, reason, review AS needs_review FROM told WHERE NOT ({_NO})",
    "custom_compatibility": f"""WITH {PAIRS}, {legs(road, 'pairs', 'legs')}, {legs(hav, 'pairs', 'straight')},
m AS (SELECT *, {road(*AE)} AS a_km, {road(*BE)} AS b_km, {gap(bear(*AE), bear(*BE))} AS g, {RATIO} AS ratio FROM legs),
d AS (SELECT a_id, b_id, a_place, b_place, between_km, {OFFSET} AS detour FROM straight)
SELECT 'custom' AS scenario_id, 'Short detours' AS label, m.a_id, m.b_id, CASE WHEN {sql_rnd('a_km', 6)} < 20 AND {sql_rnd('b_km', 6)} < 20 THEN 'short_haul'
 WHEN {sql_rnd('g', 9)} > 60 THEN 'bearing' WHEN {sql_rnd('ratio', 9)} > 112e-2 THEN 'detour' ELSE 'ok' END AS verdict,
 CASE WHEN d.a_place = d.b_place THEN 'exact_lane' WHEN {sql_rnd('d.between_km', 6)} <= 30 THEN 'dest_cluster' WHEN {sql_rnd('d.detour', 6)} <= 12e-2 THEN 'corridor' ELSE 'none' END AS clustering
FROM m JOIN d ON m.a_id = d.a_id AND m.b_id = d.b_id""",
    "mixed_labels": f"""WITH {_MIXED}, g AS (SELECT period, pickup_hub, slot, count(*) AS n, sum(weight_kg) AS kg, count(DISTINCT delivery_hub) AS dests,
  arg_min(delivery_hub, place) AS d1, arg_max(delivery_hub, place) AS d2 FROM slotted GROUP BY ALL)
SELECT period, pickup_hub, slot, CAST(n AS INT) AS cluster_n, {sql_rnd('kg', 2)} AS cluster_weight_kg, CASE WHEN n = 1 THEN 'singleton' WHEN dests > 1 THEN 'corridor' ELSE 'exact_lane' END AS cluster_type,
 pickup_hub || ' → ' || CASE WHEN dests = 1 THEN d1 ELSE '[' || d1 || ', ' || d2 || ']' END AS cluster_lane FROM g""",
    "pair_map": f"""WITH {TRUCKS}, p AS (SELECT truck_id, count(*) AS pickups, avg(pickup_lat) AS plat, avg(pickup_lng) AS plng FROM (SELECT DISTINCT truck_id, pickup_lat, pickup_lng FROM named) GROUP BY 1),
d AS (SELECT DISTINCT truck_id, delivery_lat, delivery_lng FROM named)
SELECT f.truck_id, name AS assigned_vehicle, lane AS group_lane, CAST(pickups AS INT) AS pickups, {sql_rnd('plat', 6)} AS pickup_lat, {sql_rnd('plng', 6)} AS pickup_lng,
 {sql_rnd('delivery_lat', 6)} AS delivery_lat, {sql_rnd('delivery_lng', 6)} AS delivery_lng,
 CAST(('0x' || substr(md5(f.truck_id), 1, 4))::INT % 15 AS INT) AS colour FROM truck f JOIN p ON p.truck_id = f.truck_id JOIN d ON d.truck_id = f.truck_id""",
    "zones_improving": f"""WITH {_IMPROVING} SELECT zone_id, CAST(adjustments AS INT) AS adjustments_made, avg AS current_lf, CAST(resolution AS INT) AS current_res FROM zones WHERE adjustments > 0 AND avg > 65e-2""",
    "zones_reset": f"""WITH {_IMPROVING}, f AS (SELECT *, zone_id = min(zone_id) OVER () AS cleared FROM zones)
SELECT zone_id, CAST(resolution AS INT) AS resolution, CAST(CASE WHEN cleared THEN 0 ELSE rn END AS INT) AS run_count, CASE WHEN cleared THEN 0e0 ELSE avg END AS avg_load_factor,
 CASE WHEN cleared THEN 0e0 ELSE last END AS last_load_factor, CASE WHEN cleared THEN NULL ELSE run END AS last_run FROM f""",
    "zone_log": f"""WITH {_IMPROVING}, chosen AS (SELECT zone_id FROM zones ORDER BY adjustments DESC, zone_id LIMIT 1),
steps AS (SELECT f.*, {_BEFORE} AS before, max(rn) OVER (PARTITION BY zone_id) AS top_rn, last_value(avg) OVER (PARTITION BY zone_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM fold f)
SELECT s.zone_id, CAST(top_rn AS INT) AS run_count, final AS avg_load_factor, CAST(rn AS INT) AS run, before AS from_resolution, CAST(resolution AS INT) AS to_resolution, reason
FROM steps s JOIN chosen c ON c.zone_id = s.zone_id WHERE before <> resolution""",
}
