import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import model
from haulplan.operators import loading, vehicles
from haulplan.plans.dispatch import route_groups, run_plan, truck_shipments
from haulplan.plans.params import BALANCED, PRESETS, Scenario, variants
from haulplan.session import Stages, shared_folder

SCHEMA = (
    "shipment_id string, period string, pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double, "
    "weight_kg double, length_cm int, width_cm int, height_cm int, earliest_s long, latest_s long, goods_type string, "
    "pickup_hub string, delivery_hub string"
)
HUBS = [(19.296, 73.066), (18.903, 73.111), (18.658, 73.773), (18.534, 73.854), (19.218, 72.978), (21.170, 72.831)]
DROPS = [(18.520, 73.856), (21.195, 72.830), (23.022, 72.571), (17.385, 78.487), (13.067, 80.237), (19.076, 72.877)]
GOODS = ["electronics", "pharma_medical", "steel_metal_parts", "fmcg_packaged_goods", "other"]


def make_rows(n, seed, hubs=6, drops=6, heavy=22_500, periods=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p, d = rng.choice(HUBS[:hubs]), rng.choice(DROPS[:drops])
        e = rng.randint(6 * 60, 16 * 60) * 60
        weight = rng.choice([rng.uniform(300, 5000), rng.uniform(300, heavy)])
        rows.append(
            (
                f"S{i:04d}", rng.choice(periods), round(p[0] + rng.uniform(-0.06, 0.06), 4), round(p[1] + rng.uniform(-0.06, 0.06), 4),
                round(d[0] + rng.uniform(-0.07, 0.07), 4), round(d[1] + rng.uniform(-0.07, 0.07), 4), round(weight, 1),
                rng.randint(60, 600), rng.randint(50, 240), rng.randint(40, 230), e, e + rng.choice([10, 60, 120, 240]) * 60,
                rng.choice(GOODS), None, None,
            )
        )
    return rows


def as_model(rows, period):
    return [
        {
            "id": r[0], "plat": r[2], "plng": r[3], "dlat": r[4], "dlng": r[5], "u": round(r[6] * 1000),
            "vol": float(r[7] * r[8] * r[9]), "e": r[10], "l": r[11],
        }
        for r in rows
        if r[1] == period
    ]


def groups_of(df, col):
    return {frozenset(x["shipment_id"] for x in r["items"]) for r in df.select("items").collect()}


CASES = [(180, 1, 6, 6, BALANCED), (180, 2, 2, 2, BALANCED), (150, 3, 6, 6, PRESETS[4]), (150, 4, 6, 6, PRESETS[1])]


@pytest.mark.parametrize("n,seed,hubs,drops,sc", CASES)
def test_plan_equals_sequential_model(spark, n, seed, hubs, drops, sc):
    rows = make_rows(n, seed, hubs, drops)
    run = run_plan(spark, spark.createDataFrame(rows, SCHEMA), (sc,))
    want_groups, want_corridor, want_routes = set(), set(), set()
    for period in ("a", "b"):
        groups, corridor = model.cluster(as_model(rows, period), sc)
        want_groups |= {frozenset(s["id"] for s in g) for g in groups}
        want_corridor |= corridor
        want_routes |= {frozenset(s["id"] for s in r) for r in model.routes(groups, sc)}
    assert groups_of(run.grouping.groups, "items") == want_groups
    paired = run.grouping.groups.filter("multi_drop")
    assert {i for g in groups_of(paired, "items") for i in g} == want_corridor
    assert groups_of(run.routes, "items") == want_routes
    on_truck = [r["shipment_id"] for r in truck_shipments(run.trucks).select("shipment_id").collect()]
    left = [r["shipment_id"] for r in run.exceptions.select("shipment_id").collect()]
    assert sorted(on_truck + left) == sorted(r[0] for r in rows)
    assert set(left) == {r[0] for r in rows if r[6] > 22_000}
    worst = run.trucks.agg(F.max("weight_kg").alias("kg"), F.max("route_volume_cm3").alias("v")).first()
    assert worst["kg"] <= 22_000


def test_result_does_not_depend_on_order_or_partitions(spark):
    rows = make_rows(160, 7)
    first = run_plan(spark, spark.createDataFrame(rows, SCHEMA))
    random.Random(1).shuffle(rows)
    second = run_plan(spark, spark.createDataFrame(rows, SCHEMA).repartition(7))
    key = lambda run: {(r["truck_id"], tuple(r["stop_sequence"]), r["assigned_vehicle"], r["load_factor"], r["cost_estimate_inr"]) for r in run.trucks.collect()}
    assert key(first) == key(second)


def test_hot_lane_is_whole(spark):
    """One lane holds everything and one weight dominates; ranks come from counts."""
    rows = [
        (f"H{i:05d}", "a", 19.30, 73.06, 18.52, 73.86, 700.0 if i % 3 else 650.0 + i % 50, 60, 50, 40, 30000 + i % 7, 60000 + i % 11, "other", None, None)
        for i in range(3000)
    ]
    run = run_plan(spark, spark.createDataFrame(rows, SCHEMA))
    got = run.grouping.units.select("n", F.expr("aggregate(items.weight_u, 0L, (a, x) -> a + x)").alias("u")).collect()
    assert sum(r["n"] for r in got) == 3000
    want = model.first_fit(sorted([{"u": round(r[6] * 1000)} for r in rows], key=lambda s: -s["u"]), lambda s: s["u"], model.CAP)
    assert sorted(r["u"] for r in got) == sorted(sum(s["u"] for s in b) for b in want)


def test_review_decisions_block_a_pair(spark):
    base = ("a", 19.30, 73.06)
    rows = [
        ("A", *base, 18.52, 73.86, 900.0, 60, 50, 40, 30000, 60000, "other", None, None),
        ("B", *base, 18.25, 73.55, 800.0, 60, 50, 40, 30000, 60000, "other", None, None),
    ]
    sc = Scenario("t", "t", delivery_cluster_km=40.0, clustering_detour=0.5)
    df = spark.createDataFrame(rows, SCHEMA)
    # their places lie over 40 km apart, so only the corridor pass can join them
    free = run_plan(spark, df, (sc,)).grouping.groups.select("corridor_reason", "hitl_reviewed", "cluster_n").collect()
    assert [(r["cluster_n"], r["hitl_reviewed"]) for r in free] == [(2, True)]
    no = spark.createDataFrame([("B", "A", False)], "id_a string, id_b string, approved boolean")
    assert run_plan(spark, df, (sc,), decisions=no).grouping.groups.count() == 2


def test_scenarios_in_one_run_equal_single_runs(spark):
    rows = make_rows(120, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    both = run_plan(spark, df, (PRESETS[1], PRESETS[3]))
    for sc in (PRESETS[1], PRESETS[3]):
        alone = groups_of(run_plan(spark, df, (sc,)).routes, "items")
        assert groups_of(both.routes.filter(F.col("scenario_id") == sc.scenario_id), "items") == alone


def test_scenarios_share_the_stages_they_agree_on(spark, tmp_path):
    df = spark.createDataFrame(make_rows(160, 5), SCHEMA)
    base = PRESETS[2]
    sweep = (
        base, replace(base, scenario_id="short", route_detour=1.02, max_bearing_diff=10.0), replace(base, scenario_id="twin"),
        replace(base, scenario_id="near", clustering_detour=0.02), replace(base, scenario_id="long", min_overlap_minutes=120),
        replace(base, scenario_id="wide", pickup_radius_km=120.0),
    )
    stages = Stages(spark)
    run = run_plan(spark, df, sweep, stages=stages)
    planned = lambda name: {r[0] for r in spark.read.parquet(f"{stages.root}/{name}").select("scenario_id").distinct().collect()}
    assert planned("lanes") == {"balanced", "wide"} and planned("units") == {"balanced", "long", "wide"}
    assert planned("groups") == {"balanced", "near", "long", "wide"}
    assert planned("trucks") == {"balanced", "short", "near", "long", "wide"}
    told = lambda r: sorted(
        (t["truck_id"], t["group_id"], t["assigned_vehicle"], t["group_weight_kg"], t["load_factor"], tuple(x["shipment_id"] for x in t["items"]))
        for t in r
    )
    together = run.trucks.collect()
    for sc in sweep:
        alone = run_plan(spark, df, (sc,))
        assert told(t for t in together if t["scenario_id"] == sc.scenario_id) == told(alone.trucks.collect())
        for name in ("unit_map", "groups", "units"):
            key = "unit_id" if name != "groups" else "group_id"
            ids = lambda f: sorted(r[0] for r in f.select(key).collect() if r[0].startswith(sc.scenario_id + "|"))
            assert ids(getattr(run.grouping, name)) == ids(getattr(alone.grouping, name))
    assert len({t["truck_id"] for t in together}) == len(together)


def test_variants_cover_every_combination():
    some = variants(PRESETS[2], route_detour=(1.1, 1.2), max_bearing_diff=(30.0, 45.0))
    assert len({s.scenario_id for s in some}) == 4 and {(s.route_detour, s.max_bearing_diff) for s in some} == {(a, b) for a in (1.1, 1.2) for b in (30.0, 45.0)}


def test_same_lane_disjoint_windows_keep_both(spark):
    rows = [
        (f"D{i}", "a", 19.30, 73.06, 18.52, 73.86, 900.0, 60, 50, 40, 30000 + i * 20000, 33000 + i * 20000, "other", None, None)
        for i in range(2)
    ]
    assert run_plan(spark, spark.createDataFrame(rows, SCHEMA)).trucks.count() == 2


def test_convoys_are_whole_and_within_payload(spark):
    rows = make_rows(400, 21, 1, 1, 21_000, ("a",)) + [("X", "a", 19.3, 73.0, 18.5, 73.8, 23_000.0, 60, 50, 40, 0, 9, "other", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("weight_u", (F.col("weight_kg") * 1000).cast("long"))
    out = loading.convoys(df, ["period"]).collect()
    ids = [x["shipment_id"] for r in out for x in r["items"]]
    assert sorted(ids) == sorted(r[0] for r in rows if r[6] <= 22_000)
    assert all(r["weight_kg"] <= 22_000 for r in out)
    assert all(1 <= r["convoy_truck_num"] <= r["convoy_truck_count"] for r in out)


def test_a_demand_over_500_shipments_is_packed_whole(spark):
    rows = make_rows(1201, 22, 1, 1, 9_000, ("a",))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("weight_u", (F.col("weight_kg") * 1000).cast("long"))
    out = loading.convoys(df, ["period"]).collect()
    assert {r["convoy_truck_count"] for r in out} == {len(out)}
    assert sorted(r["convoy_truck_num"] for r in out) == list(range(1, len(out) + 1))

    # one by one, as the reference does: largest box first, the truck nearest to the target
    order = sorted(rows, key=lambda r: (-r[7] * r[8] * r[9], -int(r[6] * 1000), r[0]))
    trucks, want = [], []
    for r in order:
        l, w, h, kg = map(float, (*r[7:10], r[6]))
        upright, on_top = loading.STACKING.get(r[12], loading.STACKING_DEFAULT)[:2]
        fits = [i for i, t in enumerate(trucks) if t.kg + kg <= t.max_kg]
        near = lambda i: 0.5 * abs((trucks[i].kg + kg) / trucks[i].max_kg - 0.72) + 0.5 * abs((trucks[i].volume + l * w * h) / trucks[i].capacity - 0.72)
        if not fits:
            trucks.append(loading.Hold(*map(float, (loading.LARGEST.l, loading.LARGEST.w, loading.LARGEST.h, loading.LARGEST.max_kg))))
            want.append([])
        at = min(fits, key=near) if fits else len(trucks) - 1
        trucks[at].add(l, w, h, kg, upright, on_top)
        want[at].append(r[0])
    got = {r["convoy_truck_num"]: sorted(x["shipment_id"] for x in r["items"]) for r in out}
    assert got == {i + 1: sorted(ids) for i, ids in enumerate(want)}


def test_ranked_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("t"), "id").alias("t"))
    got = vehicles.ranked(df, ["k"], "t").groupBy("k").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d"))
    assert all(r["a"] == 1 and r["b"] == r["n"] == r["d"] for r in got.collect())


def test_single_box_expression_equals_helper(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        l, w, h = (rng.randint(30, 400) for _ in range(3))
        rows.append((f"B{i}", float(l), float(w), float(h), rng.choice(GOODS + ["construction_material"])))
    df = spark.createDataFrame(rows, "id string, l double, w double, h double, g string").select(
        "*", F.array(*[F.lit(float(x)) for x in (290, 175, 150, 2000)]).alias("hold"),
        F.array(
            F.struct(
                F.col("id").alias("shipment_id"), F.col("l").alias("length_cm"), F.col("w").alias("width_cm"), F.col("h").alias("height_cm"),
                F.lit(100.0).alias("weight_kg"), F.lit(100_000).cast("long").alias("weight_u"), F.col("g").alias("goods_type"),
            )
        ).alias("items"),
    )
    for rotate in (True, False):
        for r in loading.load_plan(df, rotate=rotate).collect():
            up, top = loading.STACKING.get(r["g"], loading.STACKING_DEFAULT)
            ((x, y, z, l, w, h, bulk),), used, layers = loading.load_truck([r["l"]], [r["w"]], [r["h"]], [100.0], [up], [top], (290.0, 175.0, 150.0, 2000.0), rotate=rotate)
            b = r["load"][0]
            assert (b["l"], b["w"], b["h"], b["bulk"], r["layers"]) == (l, w, h, bulk, layers)
            assert r["used_cm3"] == pytest.approx(used)


class _Session:
    """Stands in for a session whose setting is given."""

    def __init__(self, spark, master, folder):
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"{master}-{folder}", "setCheckpointDir": lambda *_: None})()
        self.conf = type("R", (), {"get": lambda *_: folder})()


def test_stage_tables_live_in_the_shared_folder(spark):
    assert Stages(spark).root.startswith(shared_folder(spark))
    assert shared_folder(_Session(spark, "yarn", "hdfs:///shared")) == "hdfs:///shared"
    alone = _Session(spark, "local[2]", None)
    assert shared_folder(alone) == shared_folder(alone)
    with pytest.raises(RuntimeError):
        shared_folder(_Session(spark, "local-cluster[2,1,1024]", None))
    stages = Stages(spark)
    assert stages.save(spark.range(3), "x").count() == 3
    stages.remove()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{stages.root}/x")
    with pytest.raises(RuntimeError):
        shared_folder(_Session(spark, "yarn", None))


def test_exactly_full_trucks_have_a_vehicle(spark):
    """Loads of exactly the payload whose sum of doubles lies above it."""
    loads = [(5949.9, 5779.6, 5497.9, 2412.7, 2359.9)]
    rng = random.Random(12)
    while len(loads) < 40:
        cuts = sorted(rng.sample(range(1, 220_000), rng.randint(2, 5)))
        loads.append([(b - a) / 10 for a, b in zip([0, *cuts], [*cuts, 220_000])])
    rows = [
        (f"F{g}-{i}", f"day{g}", 19.30, 73.06, 18.52, 73.86, kg, 60, 50, 40, 30000, 60000, "other", None, None)
        for g, load in enumerate(loads) for i, kg in enumerate(load)
    ]
    run = run_plan(spark, spark.createDataFrame(rows, SCHEMA))
    got = run.trucks.select("group_size", "weight_kg", "assigned_vehicle", "cost_estimate_inr").collect()
    assert len(got) == len(loads) and all(r["weight_kg"] == 22_000.0 for r in got)
    assert all(r["assigned_vehicle"] and r["cost_estimate_inr"] > 0 for r in got)
    assert run.exceptions.count() == 0


def test_the_route_helper_runs_once(spark):
    rows = make_rows(60, 5, 2, 2, 3_000, ("a",))
    run = run_plan(spark, spark.createDataFrame(rows, SCHEMA))
    plan = route_groups(run.grouping.groups, (BALANCED,))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
