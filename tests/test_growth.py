"""What keeps time and shuffles in step with the input: read off the plans, and hot keys against the plain way."""

import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from haulplan.functions.measures import best_vehicle
from haulplan.llm import toxicity
from haulplan.operators import loading, payload, proximity, route, vehicles
from haulplan.plans import pairs, queries
from haulplan.plans.dispatch import pack_routes, run_plan
from haulplan.plans.params import BALANCED, variants
from haulplan.session import Stages

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_solo_figures_are_told_from_a_table_of_routes(spark):
    """the filters on weight and size used to run the distances of every shipment inside the join."""
    trucks, _ = pack_routes(queries.solo_routes(spark, SF))
    plan = plan_of(trucks)
    assert "Join" not in plan
    assert not any("ATAN2" in line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter"))


def test_the_vehicle_of_a_solo_route_is_chosen_once(spark):
    """A filter or join on what hangs on the vehicle used to repeat the comparison of all types, until the driver's memory was full."""
    trucks, exceptions = queries.solo_trucks(spark, SF)
    for told in (trucks.groupBy("assigned_vehicle").count(), vehicles.vehicle_numbers(trucks.select("scenario_id", "period", "truck_id", "assigned_vehicle"))):
        assert "least(" not in plan_of(told) and "raise_error" not in plan_of(told)
    whole = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet"), F.expr("l_orderkey = o_orderkey")).count()
    assert trucks.count() + exceptions.count() == whole
    assert queries.zone_ema(spark, SF).filter("run_count > 0").count() > 0


def pair_rows(spark):
    end = lambda k: ((F.col("id") * k) % 90 / 1000.0)
    return spark.range(400).select(
        F.concat(F.lit("S"), "id").alias("shipment_id"), F.lit("w1").alias("period"),
        (19.2 + end(7)).alias("pickup_lat"), (73.0 + end(11)).alias("pickup_lng"), (18.5 + end(13)).alias("delivery_lat"), (73.8 + end(17)).alias("delivery_lng"),
        (F.col("id") * 37 % 23 * 1000.0 + 50).alias("weight_kg"), F.lit(60).alias("length_cm"), F.lit(50).alias("width_cm"), F.lit(40).alias("height_cm"),
        F.lit(30000).cast("long").alias("earliest_s"), F.lit(60000).cast("long").alias("latest_s"), F.lit("other").alias("goods_type"),
        F.when(F.col("id") % 5 == 0, "A").otherwise("B").alias("pickup_hub"), F.lit("Z").alias("delivery_hub"),
    )


def test_pairs_of_hot_and_other_lanes_are_the_same(spark, monkeypatch):
    """rows of a lane that one task can sort move once; hot lanes go by buckets, to the same routes."""
    rows = pair_rows(spark)
    told = lambda: sorted((r["route_id"], r["group_size"], tuple(x["shipment_id"] for x in r["items"])) for r in pairs.pair_routes(rows).collect())
    cool = told()
    monkeypatch.setattr(vehicles, "HOT_ROWS", 100)
    assert told() == cool and sum(n for _, n, _ in cool) == 400
    monkeypatch.setattr(vehicles, "HOT_ROWS", 1)
    assert told() == cool


def test_pair_statistics_need_no_table_of_trucks(spark):
    """whole trucks with their loads used to be written to tell eight numbers of each."""
    plan = plan_of(pairs.pair_route_stats(spark, SF))
    assert "_load_udf" not in plan and "Join" not in plan and "pair_trucks" not in " ".join(pairs.pair_trucks(spark, SF).inputFiles())


def test_the_clock_of_a_lane_is_made_once(spark):
    """the running totals used to be made for the starts and again for the ends."""
    rows = spark.createDataFrame([("a", "l", 0, 10), ("b", "l", 5, 20), ("c", "l", 10, 30), ("d", "m", 0, 9)], "shipment_id string, lane string, earliest_s long, latest_s long")
    out = proximity.overlap_partners(rows, ["lane"], Stages(spark))
    assert "Window" not in plan_of(out)
    assert sorted((r["shipment_id"], r["lane_mates"], r["overlapping"]) for r in out.collect()) == [("a", 2, 1), ("b", 2, 2), ("c", 2, 1), ("d", 0, 0)]


def test_lone_shipments_are_counted_per_start_at_once(spark):
    """shipments used to be grouped by start and end first, which hardly made them fewer."""
    view = plan_of(queries.lane_singles(spark, SF))
    assert sum("Aggregate [ship_week" in line for line in view.splitlines()) == 2


def test_best_vehicle_is_null_where_no_type_carries_the_load(spark):
    """every type is a plain expression; a load above all payloads, or of unknown weight, has none."""
    rows = spark.createDataFrame([("a", 500.0), ("b", 30_000.0), ("c", None), ("d", 22_000.0), ("e", float("nan"))], "id string, kg double")
    got = rows.withColumns({"cm3": F.lit(1e6), "km": F.lit(100.0)}).select("id", best_vehicle("kg", "cm3", "km").alias("v")).collect()
    assert {r["id"] for r in got if r["v"] is None} == {"b", "c", "e"}
    assert {r["v"] for r in got if r["id"] == "d"} == {"Volvo FH 40ft (FTL)"}


def test_a_load_stands_once_in_the_comparison_of_types(spark):
    """Written out for every type, the comparison was too long a method for Java to compile."""
    df = spark.range(5).select(F.col("id").cast("double").alias("kg"), F.col("id").cast("double").alias("cm3"), F.col("id").cast("double").alias("km"))
    text = plan_of(df.select(best_vehicle("sin(kg)", "cos(cm3)", "tan(km)").alias("v")))
    assert [text.count(f"{f}(") for f in ("SIN", "COS", "TAN")] == [1, 1, 1]


def test_solo_features_read_the_routes_once(spark):
    """statistics of single trucks walked arrays, and the table of solo routes was read twice."""
    plan = plan_of(queries.solo_features(spark, SF))
    assert "Union" not in plan and plan.count("Relation [") == 1


def test_short_tours_are_ordered_from_a_table(monkeypatch):
    """Every step of a short tour made and shrank arrays."""
    rng = np.random.default_rng(6)
    sizes = [2, 3, 6, 7, 12, 40]
    col = lambda low, high: [rng.uniform(low, high, n) for n in sizes]
    cols = [col(19.0, 19.2), col(73.0, 73.2), col(18.0, 19.0), col(73.3, 74.3), col(1e5, 3e6), col(0, 86_400)]
    cols[2][3][4] = float("nan")
    planned = lambda: [[list(map(int, r)) for r in g] for g in route.plan_batch(*cols, [45.0] * len(sizes), [1.6] * len(sizes))]
    got = planned()
    monkeypatch.setattr(route, "SMALL_GROUP", 0)
    assert planned() == got and any(len(r) > 2 for g in got for r in g)
    cols[2][3][4] = 18.5
    monkeypatch.setattr(route, "SMALL_GROUP", 64)
    monkeypatch.setattr(np, "delete", None)
    assert sorted(sum(planned()[3], [])) == list(range(7))


def test_helpers_travel_to_workers_without_the_package(tmp_path):
    """A cached function goes by the name of its module, which an executor does not have."""
    from pyspark import cloudpickle

    sent = cloudpickle.dumps((route.plan_batch, loading.TruckIndex, loading.load_truck))
    code = "import sys, pickle; plan, index, load = pickle.loads(sys.stdin.buffer.read()); print(plan(*[[[1.0, 2.0, 3.0]]] * 6, [45.0], [9.0]), index().opened)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(os.path.dirname(cloudpickle.__file__)) + "/.."}
    done = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd=tmp_path, env=env, timeout=60)
    assert done.returncode == 0, done.stderr.decode()


def test_few_trucks_are_scored_without_a_grid(monkeypatch):
    """every box of a small demand searched a grid of 4,096 cells."""
    rng = random.Random(4)
    box = lambda: (*(float(rng.randint(40, 400)) for _ in range(3)), float(rng.randint(50, 9_000)), rng.random() < 0.2, rng.choice([0.0, 200.0, 1000.0]))
    boxes = sorted((box() for _ in range(400)), key=lambda b: -(b[0] * b[1] * b[2]))

    def packed(few: int):
        monkeypatch.setattr(loading.TruckIndex, "FEW", few)
        index = loading.TruckIndex(min(b[3] for b in boxes))
        return [index.put(b) for b in boxes], index

    few, plain = packed(10_000)
    assert not plain.members
    for limit in (0, 20):  # the grid from the start, and made midway
        got, index = packed(limit)
        assert got == few and index.members and index.count.sum() == len(index.holds)


def plan_rows(spark, n=100):
    """Shipments of one day and one pickup, whose deliveries lie on a fan: wider limits share more trucks."""
    rng = random.Random(3)
    rows = [
        (f"S{i}", "d1", 19.30, 73.06, 18.2 + rng.random(), 73.3 + rng.random(), 300.0 + rng.randint(0, 9) * 200, 60, 50, 40, 30000 + 60 * rng.randint(0, 9), 60000, "other", None, None)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "shipment_id string, period string, pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double, weight_kg double, "
        "length_cm int, width_cm int, height_cm int, earliest_s long, latest_s long, goods_type string, pickup_hub string, delivery_hub string",
    )


def test_route_limits_share_routes_and_loads(spark):
    """every limit used to split, annotate and load all routes once more."""
    limits = variants(BALANCED, max_bearing_diff=(10.0, 45.0))
    rows = plan_rows(spark)
    run = run_plan(spark, rows, limits)
    figures = lambda df: sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())
    for s in limits[1:]:
        alone = run_plan(spark, rows, (s,))
        for name in ("routes", "trucks", "exceptions"):
            got, want = getattr(run, name).filter(F.col("scenario_id") == s.scenario_id), getattr(alone, name)
            assert figures(got.select(*want.columns)) == figures(want)
    told = run.trucks.select("scenario_id", F.array_join("stop_sequence", " ").alias("r")).collect()
    assert len({r["r"] for r in told}) < len(told)  # limits agree on some routes and differ on others
    assert spark.read.parquet(*run.trucks.inputFiles()).count() == len({r["r"] for r in told})


def test_a_run_keeps_no_table_that_nothing_reads(spark):
    """Tables of finished steps stayed, and the ids of a truck were written three times."""
    stages = Stages(spark)
    run = run_plan(spark, plan_rows(spark), (BALANCED,), stages=stages)
    assert not {"lane_windows", "windowed", "corridor_pairs"} & set(os.listdir(stages.root))
    kept = spark.read.parquet(f"{stages.root}/trucks")
    assert "stop_sequence" not in kept.columns and not {"shipment_id", "kg"} & set(kept.select(F.explode("load").alias("b")).select("b.*").columns)
    for r in run.trucks.collect():
        weights = {x["shipment_id"]: x["weight_kg"] for x in r["items"]}
        assert r["stop_sequence"] == [x["shipment_id"] for x in r["items"]]
        assert {b["shipment_id"]: b["kg"] for b in r["load"]} == weights and len(r["load"]) == len(weights)
    assert all(r["stop_sequence"] == [x["shipment_id"] for x in r["items"]] for r in run.routes.collect())


def test_groups_of_a_known_size_are_not_counted_for_heat(spark, monkeypatch):
    """every payload split counted its rows once more to find hot weights, though the size of the group was known."""
    rows = spark.range(300).select(
        F.when(F.col("id") < 200, "a").otherwise("b").alias("window_id"), (F.col("id") % 7 * 1_000_000 + 2_000_000).alias("weight_u"),
        F.lit(0).cast("long").alias("earliest_s"), F.concat(F.lit("S"), "id").alias("shipment_id"), F.when(F.col("id") < 200, 200).otherwise(100).alias("group_n"),
    )
    told = lambda df: sorted(tuple(r) for r in payload.split_payload(df).select("window_id", "shipment_id", "bin_no").collect())
    want = told(rows.drop("group_n"))
    assert told(rows) == want and len(want) == 300
    for few in (1, 10, 150):  # both groups, one, some weights of one
        monkeypatch.setattr(vehicles, "HOT_ROWS", few)
        assert told(rows) == want
    kept = Stages(spark).save(rows, "over")
    assert "> 150)" in plan_of(vehicles.by_heat(kept, ["window_id", "weight_u"], ["shipment_id"], "group_n")[0])


def test_pairs_of_small_groups_are_measured_once(spark, monkeypatch):
    """the routes from verdicts of all pairs are those of testing item by item, under every limit."""
    rng = random.Random(9)
    sizes = [rng.randint(2, 14) for _ in range(60)]
    ends = [[[lo + rng.choice([rng.random(), 0.5]) for _ in range(n)] for n in sizes] for lo in (19.0, 73.0, 18.4, 73.2)]
    volume = [[rng.random() * route.K.ROUTE_VOLUME_CAP_CM3 / 5 for _ in range(n)] for n in sizes]
    deadline = [[rng.randint(0, 5) for _ in range(n)] for n in sizes]
    bearing, detour = [[10.0, 45.0, 90.0]] * len(sizes), [[1.4, 1.1, 2.0]] * len(sizes)
    asked = []
    measure = route.PairTester.measure
    monkeypatch.setattr(route.PairTester, "measure", lambda self, i, j: (asked.append(1), measure(self, i, j))[1])
    once = route.plan_batch_under(*ends, volume, deadline, bearing, detour)
    assert len(asked) == 1
    monkeypatch.setattr(route, "SMALL_GROUP", 0)
    assert once == route.plan_batch_under(*ends, volume, deadline, bearing, detour)
    assert len({str(x) for x in once[0]} | {str(x) for x in once[1]}) > 2
    for k in range(3):
        assert [r[k] for r in once] == route.plan_batch(*ends, volume, deadline, [bearing[0][k]] * len(sizes), [detour[0][k]] * len(sizes))


def test_lane_facts_are_summed_by_hash(spark):
    """an anchor with an id among the sums used to sort all rows, and legs were worked out anew at every mention."""
    rng = random.Random(4)
    nan = float("nan")
    rows = [("w1", f"P{i % 3}", "D", f"S{i:03d}", rng.choice([100.0, 250.0, 900.0]), 19.0 + rng.random(), 73.0, 18.0 + rng.random(), 74.0) for i in range(90)]
    rows += [("w2", "P", "D", "S3", 5.0, 19.0, 73.0, 18.0, 74.0), ("w2", "P", "D", "S2", None, 19.0, 73.0, 18.5, 74.0), ("w2", "P", "D", "S1", 70.0, 19.0, 73.0, 18.0, 74.0)]
    rows += [("w3", "P", "D", "S3", nan, 19.0, 73.0, 18.0, 74.0), ("w3", "P", "D", "S2", 1.0, 19.0, 73.0, 18.0, 74.0), ("w4", "P", "D", "S1", nan, 19.0, 73.0, 18.0, 74.0)]
    view = spark.createDataFrame(rows, "ship_week string, pickup_hub string, delivery_hub string, shipment_id string, weight_kg double, pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double")
    plans = {}

    class Seen(Stages):
        def save(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().save(df, name)

    got = {tuple(r[k] for k in queries.LANE): r["a"] for r in queries.lane_facts(view, Seen(spark)).collect()}
    order = F.struct(-F.col("weight_kg"), F.col("shipment_id"))
    want = view.groupBy(*queries.LANE).agg(F.min_by(F.struct("shipment_id", "delivery_lat"), order).alias("a")).collect()
    assert {k: (a["id"], a["dlat"]) for k, a in got.items()} == {tuple(r[k] for k in queries.LANE): tuple(r["a"]) for r in want}
    assert len(got) == 6 and got["w2", "P", "D"]["id"] == "S2" and got["w3", "P", "D"]["id"] == "S2"
    assert "HashAggregate" in plans["lane_sums"] and "SortAggregate" not in plans["lane_sums"]


def test_the_toxicity_sample_takes_a_byte_a_term(monkeypatch):
    """pipeline: the driver used to hold the sample as floats, and as lists of Python numbers before that."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(1000, 40, replace=False)) for _ in range(6000)]
    toxic = np.array([float(3 in r or 700 in r) for r in rows])
    tracemalloc.start()
    machine = toxicity.fit_machine(rows, toxic, np.arange(1000), 4, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6 and machine.linear[3] > 0 and machine.linear[700] > 0
    some, told = [r[r < 60] for r in rows[:3000]], toxic[:3000]
    whole = toxicity.joint_terms(some, told, 60, 20, at_least=0.0)
    monkeypatch.setattr(toxicity, "ROWS_AT_ONCE", 101)
    assert whole.size == 20 and (toxicity.joint_terms(some, told, 60, 20, at_least=0.0) == whole).all()
    lists = pa.chunked_array([pa.array([[1, 2], [], [5]], pa.list_(pa.int32())), pa.array([[7]], pa.list_(pa.int32()))])
    assert [r.tolist() for r in toxicity.rows_in(lists)] == [[1, 2], [], [5], [7]]
