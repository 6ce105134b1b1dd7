"""Groups to routes to loaded trucks, and the whole run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import consolidation_type
from ..operators.loading import axle_balance, load_plan
from ..operators.route import annotate_routes, split_routes, split_routes_under
from ..operators.vehicles import choose_vehicles, split_oversize, truck_figures, with_hold
from ..session import Stages
from .grouping import ITEM_FIELDS, Grouping, group_shipments, lane_label
from .params import BALANCED, GROUP_FIELDS, TRUCK_FIELDS, hand_on, scenario_value, stand_ins


@dataclass
class Run:
    grouping: Grouping
    routes: DataFrame
    trucks: DataFrame
    exceptions: DataFrame


def heaviest_first(groups: DataFrame) -> DataFrame:
    ranked = F.sort_array(
        F.transform(
            "items",
            lambda x: F.struct(
                (-x["weight_u"]).alias("neg"), x["earliest_s"].alias("at"), x["shipment_id"].alias("id"), x.alias("item")
            ),
        )
    )
    return groups.withColumn("items", F.transform(ranked, lambda x: x["item"]))


def retyped(routes: DataFrame) -> DataFrame:
    """Type and lane of the routes themselves."""
    still_multi = F.col("multi_drop") & (F.col("group_size") > 1)
    return routes.withColumns(
        {
            "consolidation_type": consolidation_type(F.col("group_size"), F.col("multi_drop")),
            "multi_drop": still_multi,
            "hitl_reviewed": F.col("hitl_reviewed") & (F.col("group_size") > 1),
            "group_lane": lane_label(F.col("items")),
        }
    )


def route_groups(groups: DataFrame, scenarios) -> DataFrame:
    """Routes per group; type and lane are taken again after the split."""
    df = heaviest_first(groups).withColumns(
        {
            "bearing_limit": scenario_value("max_bearing_diff", scenarios),
            "detour_limit": scenario_value("route_detour", scenarios),
        }
    )
    routes = annotate_routes(split_routes(df, F.col("bearing_limit"), F.col("detour_limit")))
    return retyped(routes).drop("bearing_limit", "detour_limit")


def route_groups_under(groups: DataFrame, scenarios) -> DataFrame:
    """Routes of the groups under the limits of every scenario that shares them.

    A route that several scenarios have is one row, told in its ``uses``; it
    bears the name of the first of them.
    """
    settings = F.lit(None)
    for p in stand_ins(scenarios, GROUP_FIELDS):
        same = [s for s in scenarios if all(getattr(s, f) == getattr(p, f) for f in GROUP_FIELDS)]
        rows = [
            F.struct(
                F.lit(s.scenario_id).alias("scenario_id"), F.lit(float(s.max_bearing_diff)).alias("bearing_limit"),
                F.lit(float(s.route_detour)).alias("detour_limit"),
            )
            for s in same
        ]
        settings = F.when(F.col("scenario_id") == p.scenario_id, F.array(*rows)).otherwise(settings)
    routes = split_routes_under(heaviest_first(groups).withColumn("settings", settings))
    first = F.col("uses")[0]["scenario_id"]
    named = {c: F.concat(first, F.expr(f"substring({c}, length(scenario_id) + 1)")) for c in ("group_id", "route_id")}
    return retyped(annotate_routes(routes.withColumns({**named, "scenario_id": first})))


def every_use(df: DataFrame, route_id: str) -> DataFrame:
    """Shared routes, or their trucks, as rows of every scenario that has them, named as if it had been planned by itself."""
    member = F.col("_use.scenario_id")
    group_id = F.concat(member, F.expr("substring(group_id, length(scenario_id) + 1)"))
    used = df.withColumn("_use", F.explode("uses")).withColumn("group_id", group_id)
    return used.withColumns(
        {
            "scenario_id": member,
            route_id: F.concat_ws("#", "group_id", F.col("_use.route_no").cast("string")),
            **{c: F.col(f"_use.{c}") for c in ("route_no", "routes_in_group", "is_corridor")},
        }
    ).drop("_use", "uses")


def pack_routes(routes: DataFrame, strict: bool = True, rotate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(trucks, exceptions). One vehicle per route."""
    carried, exceptions = split_oversize(routes)
    return load_trucks(choose_vehicles(carried), strict, rotate), exceptions


def load_trucks(chosen: DataFrame, strict: bool = True, rotate: bool = True) -> DataFrame:
    """Routes with their vehicle as loaded trucks."""
    trucks = load_plan(with_hold(chosen), strict, rotate)
    return truck_figures(axle_balance(trucks)).withColumnRenamed("route_id", "truck_id")


def save_routes(routes: DataFrame, stages: Stages) -> DataFrame:
    """The stage table of routes; the stops are read off the items, so their ids are written once."""
    told = stages.save(routes.drop("stop_sequence"), "routes").withColumn("stop_sequence", F.col("items.shipment_id"))
    return told.select(*routes.columns)


def save_trucks(trucks: DataFrame, stages: Stages) -> DataFrame:
    """The stage table of trucks; what a box shares with its item is read off the item."""
    fields = [f.name for f in trucks.schema["load"].dataType.elementType]
    own = [f for f in fields if f not in ("shipment_id", "kg")]
    slim = trucks.drop("stop_sequence").withColumn("load", F.transform("load", lambda b: F.struct(*[b[f].alias(f) for f in own])))

    def whole(b):
        item = F.get("items", b["stop"])
        return F.struct(*[(b[f] if f in own else item["weight_kg" if f == "kg" else f]).alias(f) for f in fields])

    told = stages.save(slim, "trucks").withColumns({"stop_sequence": F.col("items.shipment_id"), "load": F.transform("load", whole)})
    return told.select(*trucks.columns)


def run_plan(
    spark: SparkSession,
    rows: DataFrame,
    scenarios=(BALANCED,),
    *,
    cache: DataFrame | None = None,
    decisions: DataFrame | None = None,
    stages: Stages | None = None,
    strict: bool = True,
    rotate: bool = True,
) -> Run:
    """Plan all periods and scenarios of the given shipments in one job chain.

    Every valid shipment ends on exactly one truck or in the exceptions.
    Scenarios that agree in what a stage depends on share that stage: those that
    differ in the route limits alone are clustered and grouped once, and a
    route that several of them have is annotated and loaded once.
    """
    stages = stages or Stages(spark, compression="zstd")
    grouping = group_shipments(rows, scenarios, stages, cache=cache, decisions=decisions)
    planned = stand_ins(scenarios, TRUCK_FIELDS)
    every = lambda df, *ids: hand_on(df, scenarios, TRUCK_FIELDS, ids)
    if len(planned) > len(stand_ins(scenarios, GROUP_FIELDS)):
        shared = save_routes(route_groups_under(grouping.planned, planned), stages)
        trucks = save_trucks(pack_routes(shared, strict, rotate)[0], stages)
        routes, trucks = every_use(shared, "route_id"), every_use(trucks, "truck_id")
        exceptions = split_oversize(routes)[1]
    else:
        groups = grouping.groups
        if len(planned) < len(scenarios):
            groups = groups.filter(F.col("scenario_id").isin([s.scenario_id for s in planned]))
        routes = save_routes(route_groups(groups, planned), stages)
        trucks, exceptions = pack_routes(routes, strict, rotate)
        trucks = save_trucks(trucks, stages)
    return Run(grouping, every(routes, "route_id", "group_id"), every(trucks, "truck_id", "group_id"), every(exceptions, "truck_id"))


def truck_shipments(trucks: DataFrame) -> DataFrame:
    """One row per shipment with its truck's figures; those that share a name with a shipment's field are ``truck_...``."""
    fields = (*ITEM_FIELDS, "route_km", "route_bearing")
    figures = [c for c in trucks.columns if c not in ("items", "load", "stop_sequence", "hold")]
    return trucks.select(
        *[F.col(c).alias(f"truck_{c}" if c in fields else c) for c in figures], F.posexplode("items").alias("_pos", "_item")
    ).select(
        *[f"truck_{c}" if c in fields else c for c in figures], (F.col("_pos") + 1).alias("stop_position"),
        *[F.col(f"_item.{f}").alias(f) for f in fields],
    )
