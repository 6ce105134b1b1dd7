"""Planning parameters. Every scenario is one row; its values are columns."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    label: str
    pickup_radius_km: float = 50.0
    delivery_cluster_km: float = 50.0
    min_overlap_minutes: int = 30
    clustering_detour: float = 0.20
    route_detour: float = 1.25
    max_bearing_diff: float = 45.0


# The five presets.
PRESETS = (
    Scenario("baseline", "Baseline (Solo Dispatch)", 1.0, 1.0, 480, 0.02, 1.02, 10.0),
    Scenario("conservative", "Conservative", 20.0, 15.0, 120, 0.10, 1.10, 30.0),
    Scenario("balanced", "Balanced (Recommended)", 50.0, 50.0, 30, 0.20, 1.25, 45.0),
    Scenario("aggressive", "Aggressive", 80.0, 80.0, 15, 0.35, 1.40, 60.0),
    Scenario("ultra", "Ultra Aggressive", 120.0, 100.0, 0, 0.50, 1.60, 75.0),
)
BALANCED = PRESETS[2]


def custom_scenario(
    pickup_radius_km: float = 50.0,
    delivery_cluster_km: float = 50.0,
    min_overlap_minutes: int = 30,
    max_detour_ratio: float = 1.25,
    max_bearing_diff: float = 45.0,
    label: str = "Custom",
) -> Scenario:
    """A scenario from user inputs; the clustering detour follows the route detour."""
    return Scenario(
        "custom", label, pickup_radius_km, delivery_cluster_km, min_overlap_minutes,
        round(max(max_detour_ratio - 1.0, 0.01), 3), max_detour_ratio, max_bearing_diff,
    )


#: The parameters that a stage depends on, its predecessors' included.
LANE_FIELDS = ("pickup_radius_km", "delivery_cluster_km")
UNIT_FIELDS = (*LANE_FIELDS, "min_overlap_minutes")
GROUP_FIELDS = (*UNIT_FIELDS, "clustering_detour")
TRUCK_FIELDS = (*GROUP_FIELDS, "route_detour", "max_bearing_diff")


def variants(base: Scenario, **values) -> tuple[Scenario, ...]:
    """``base`` under every combination of the given values, named after them."""
    return tuple(
        replace(base, scenario_id=f"{base.scenario_id} " + " ".join(map(str, v)), label=base.label, **dict(zip(values, v)))
        for v in product(*values.values())
    )


def stand_ins(scenarios, fields) -> tuple[Scenario, ...]:
    """The first scenario of every setting of ``fields``: a stage that depends on these alone is planned for it."""
    first: dict[tuple, Scenario] = {}
    for s in scenarios:
        first.setdefault(tuple(getattr(s, f) for f in fields), s)
    return tuple(first.values())


def hand_on(df: DataFrame, scenarios, fields, ids=()) -> DataFrame:
    """A stage planned for the stand-ins of ``fields``, as rows of every one of ``scenarios``.

    ``ids`` are the columns that begin with the scenario's id; they become what
    they would be had the scenario been planned by itself. Without a
    ``scenario_id`` the first of them tells the scenario.
    """
    planned = stand_ins(scenarios, fields)
    if len(planned) == len(scenarios):
        return df
    told = "scenario_id" in df.columns
    members = F.lit(None)
    for p in planned:
        same = [s.scenario_id for s in scenarios if all(getattr(s, f) == getattr(p, f) for f in fields)]
        is_its = F.col("scenario_id") == p.scenario_id if told else F.col(ids[0]).startswith(p.scenario_id + "|")
        members = F.when(is_its, F.array(*[F.struct(F.lit(p.scenario_id).alias("planned"), F.lit(m).alias("member")) for m in same])).otherwise(members)
    out = df.withColumn("_for", F.explode(members))
    renamed = {i: F.concat(F.col("_for.member"), F.expr(f"substring({i}, length(_for.planned) + 1)")) for i in ids}
    if told:
        renamed["scenario_id"] = F.col("_for.member")
    return out.withColumns(renamed).drop("_for")


def scenarios_df(spark: SparkSession, scenarios=PRESETS) -> DataFrame:
    return spark.createDataFrame(
        [tuple(asdict(s).values()) for s in scenarios],
        "scenario_id string, label string, pickup_radius_km double, delivery_cluster_km double, "
        "min_overlap_minutes int, clustering_detour double, route_detour double, "
        "max_bearing_diff double",
    )


def scenario_value(field: str, scenarios):
    """A parameter as a column, read off ``scenario_id``."""
    if field == "min_overlap_s":
        cases = "".join(f" WHEN '{s.scenario_id}' THEN {s.min_overlap_minutes * 60}L" for s in scenarios)
    else:
        cases = "".join(f" WHEN '{s.scenario_id}' THEN {float(getattr(s, field))}D" for s in scenarios)
    return F.expr(f"CASE scenario_id{cases} END")


def per_scenario(df: DataFrame, scenarios) -> DataFrame:
    """Each row once per scenario."""
    return df.withColumn(
        "scenario_id", F.explode(F.array(*[F.lit(s.scenario_id) for s in scenarios]))
    )
