"""Clustering: shipments to groups that may share a truck."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.measures import consolidation_type, weight_units
from ..operators.clusters import add_up, lane_clusters
from ..operators.corridor import corridor_pairs
from ..operators.payload import split_payload
from ..operators.places import assign_places
from ..operators.regroup import same_lane_regroup
from ..operators.windows import window_groups
from ..session import Stages
from .params import GROUP_FIELDS, LANE_FIELDS, UNIT_FIELDS, hand_on, scenario_value, stand_ins

ITEM_FIELDS = (
    "shipment_id", "pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng", "weight_kg", "weight_u",
    "length_cm", "width_cm", "height_cm", "earliest_s", "latest_s", "goods_type",
    "pickup_place", "delivery_place",
)
LANE = ["period", "pickup_place", "delivery_place"]
SPAN = [*LANE, "earliest_s", "latest_s"]
ATTRS = ("scenario_id", "period", "origin_cluster", "dest_cluster", "window_no")


@dataclass
class Grouping:
    shipments: DataFrame
    lanes: DataFrame
    units: DataFrame
    unit_map: DataFrame
    groups: DataFrame
    planned: DataFrame  #: the groups of the settings that were planned, before others share them


def place_shipments(rows: DataFrame, cache: DataFrame | None, stages: Stages) -> DataFrame:
    placed = assign_places(rows, cache).withColumn("weight_u", weight_units(F.col("weight_kg")))
    return stages.save(placed, "shipments")


def lane_windows(shipments: DataFrame) -> DataFrame:
    """One row per lane and window: everything that places the group borders."""
    micro = lambda c: F.sum(F.round(F.col(c) * 1_000_000).cast("long"))
    return shipments.groupBy(*SPAN).agg(
        F.count("*").alias("n"), F.sum("weight_u").alias("u"),
        micro("pickup_lat").alias("plat"), micro("pickup_lng").alias("plng"),
        micro("delivery_lat").alias("dlat"), micro("delivery_lng").alias("dlng"),
    )


def assign_windows(shipments: DataFrame, scenarios, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(shipments with clusters and window group, lane cluster table)."""
    spans = stages.save(lane_windows(shipments), "lane_windows")
    lanes = stages.save(lane_clusters(add_up(spans, LANE), stand_ins(scenarios, LANE_FIELDS)), "lanes")
    keyed = (
        spans.select(*SPAN, "n", "u")
        .join(hand_on(lanes, scenarios, LANE_FIELDS), LANE)
        .withColumn("min_overlap_s", scenario_value("min_overlap_s", scenarios))
    )
    keys = ["scenario_id", "period", "origin_cluster", "dest_cluster"]
    borders = window_groups(keyed, keys)
    fits = F.col("latest_s") - F.col("earliest_s") >= F.col("min_overlap_s")
    table = (
        keyed.select(*keys, "pickup_place", "delivery_place", "earliest_s", "latest_s", fits.alias("shareable"))
        .join(borders, [*keys, "earliest_s"], "left")
    )
    lane_id = F.concat_ws("|", "scenario_id", "period", "origin_cluster", "dest_cluster")
    window_id = F.when(
        F.col("shareable"),
        F.concat_ws("|", lane_id, F.concat(F.lit("w"), F.col("window_no.island"), F.lit("."), F.col("window_no.k"))),
    ).otherwise(F.concat_ws("|", lane_id, F.concat(F.lit("s"), F.col("shipment_id"))))
    alone = ~F.col("shareable")
    return (
        shipments.select(*ITEM_FIELDS, "period")
        .join(table, SPAN)
        .withColumns(
            {
                "window_id": window_id,
                "group_n": F.when(alone, 1).otherwise(F.col("group_n")),
                "group_u": F.when(alone, F.col("weight_u")).otherwise(F.col("group_u")),
            }
        ),
        lanes,
    )


def build_units(windowed: DataFrame) -> DataFrame:
    """Window groups cut to the payload cap, one row per resulting load.

    A load weighs at most one truck's payload, so its item list is bounded.
    Shipments that are alone in their window group need no shuffle.
    """
    alone = F.col("group_n") == 1
    over = ~alone & (F.col("group_u") > K.MAX_PAYLOAD_U)
    cols = [*ITEM_FIELDS, *ATTRS, "window_id", "shareable", "group_n"]
    carried = [*ATTRS, "shareable", "group_n"]
    single = windowed.filter(alone).select(
        F.col("window_id").alias("unit_id"), *carried, F.lit(1).alias("n"), F.array(F.struct(*ITEM_FIELDS)).alias("items")
    )
    kept = windowed.filter(~alone & ~over).select(*cols, F.col("window_id").alias("unit_id"))
    cut = split_payload(windowed.filter(over).select(*cols)).select(
        *cols, F.concat("window_id", F.lit("|b"), F.col("bin_no").cast("string")).alias("unit_id")
    )
    item = F.struct((-F.col("weight_u")).alias("neg"), F.col("earliest_s").alias("at"), *ITEM_FIELDS)
    many = (
        kept.unionByName(cut)
        .groupBy("unit_id")
        .agg(
            *[F.first(c).alias(c) for c in carried],
            F.count("*").cast("int").alias("n"),
            F.sort_array(F.collect_list(item)).alias("items"),
        )
        .withColumn("items", F.transform("items", lambda x: F.struct(*[x[f].alias(f) for f in ITEM_FIELDS])))
    )
    return single.unionByName(many)


def single_rows(units: DataFrame) -> DataFrame:
    """Loads of one shipment whose window can be shared, as flat rows."""
    one = F.element_at("items", 1)
    return units.filter((F.col("n") == 1) & F.col("shareable")).select(
        "unit_id", *ATTRS, "group_n",
        one["shipment_id"].alias("shipment_id"), one["weight_u"].alias("u"),
        one["earliest_s"].alias("start"), one["latest_s"].alias("end"),
        one["pickup_lat"].alias("plat"), one["pickup_lng"].alias("plng"),
        one["delivery_lat"].alias("dlat"), one["delivery_lng"].alias("dlng"),
        one["delivery_place"].alias("place"),
        one["pickup_place"].alias("pickup_place"), one["delivery_place"].alias("delivery_place"),
    )


def merge_singles(units: DataFrame, scenarios, decisions, stages: Stages) -> DataFrame:
    """unit_id -> group_id from the corridor pass, then the same-lane pass."""
    singles = single_rows(units)
    pairs = stages.save(corridor_pairs(singles.filter("group_n = 1"), scenarios, decisions), "corridor_pairs")
    left = singles.join(pairs.select("unit_id"), "unit_id", "left_anti")
    return stages.save(pairs.unionByName(same_lane_regroup(left, scenarios)), "unit_map")


def build_groups(units: DataFrame, unit_map: DataFrame) -> DataFrame:
    """One row per group; only merged loads are regrouped, the rest pass through."""
    attrs = [c for c in ATTRS if c != "scenario_id"]
    merged = (
        units.join(unit_map, "unit_id")
        .groupBy("scenario_id", "group_id")
        .agg(
            *[F.min_by(c, "unit_id").alias(c) for c in attrs],
            F.bool_or("multi_drop").alias("multi_drop"),
            F.min("corridor_reason").alias("corridor_reason"),
            F.bool_or("hitl_reviewed").alias("hitl_reviewed"),
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("unit_id", "items"))), lambda x: x["items"])).alias("items"),
        )
    )
    alone = units.join(unit_map.select("unit_id"), "unit_id", "left_anti").select(
        "scenario_id", F.col("unit_id").alias("group_id"), *attrs,
        F.lit(False).alias("multi_drop"),
        F.lit(None).cast("string").alias("corridor_reason"),
        F.lit(False).alias("hitl_reviewed"), "items",
    )
    return annotate(alone.unionByName(merged))


def lane_label(items) -> F.Column:
    """``A → B`` or ``A → [B, C]``, destinations in first-seen order."""
    dests = F.array_distinct(F.transform(items, lambda x: x["delivery_place"]))
    return F.concat(
        F.element_at(items, 1)["pickup_place"], F.lit(" → "),
        F.when(F.size(dests) == 1, F.element_at(dests, 1)).otherwise(
            F.concat(F.lit("["), F.array_join(dests, ", "), F.lit("]"))
        ),
    )


def annotate(groups: DataFrame) -> DataFrame:
    """Group weight, size, type and lane label from the group's items."""
    items = F.col("items")
    weight = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["weight_kg"])
    return groups.withColumns(
        {
            "cluster_n": F.size(items),
            "cluster_weight_kg": weight,
            "cluster_type": consolidation_type(F.size(items), F.col("multi_drop")),
            "cluster_lane": lane_label(items),
        }
    )


def group_shipments(
    rows: DataFrame, scenarios, stages: Stages, *, cache=None, decisions=None
) -> Grouping:
    """Groups of every scenario. A stage runs once per distinct setting of the parameters it depends on."""
    shipments = place_shipments(rows, cache, stages)
    settings, merges = stand_ins(scenarios, UNIT_FIELDS), stand_ins(scenarios, GROUP_FIELDS)
    windowed, lanes = assign_windows(shipments, settings, stages)
    windowed = stages.save(windowed, "windowed")
    stages.done("windowed", "lane_windows")
    units = stages.save(build_units(windowed), "units")
    stages.done("units", "windowed")
    loads = hand_on(units, merges, UNIT_FIELDS, ["unit_id"])
    unit_map = merge_singles(loads, merges, decisions, stages)
    stages.done("unit_map", "corridor_pairs")
    groups = stages.save(build_groups(loads, unit_map), "groups")
    stages.done("groups")
    return Grouping(
        shipments,
        hand_on(lanes, scenarios, LANE_FIELDS),
        hand_on(units, scenarios, UNIT_FIELDS, ["unit_id"]),
        hand_on(unit_map, scenarios, GROUP_FIELDS, ["unit_id", "group_id"]),
        hand_on(groups, scenarios, GROUP_FIELDS, ["group_id"]),
        groups,
    )
