import math
import random

import pytest
from haulplan.operators import feasibility, learning, metrics, proximity
from haulplan.plans.dispatch import run_plan, truck_shipments
from haulplan.plans.params import PRESETS
from haulplan.plans.scenarios import compare, recommend
from haulplan.sources.zone_store import ZoneStore
from haulplan.streaming.zones import learn_from_stream
from model import hav
from test_plan import SCHEMA, make_rows


def fold(samples):
    """Sequential zone learning."""
    zones = {}
    for zone, _, lf in sorted(samples, key=lambda s: s[1]):
        z = zones.setdefault(zone, {"res": 8, "n": 0, "avg": lf, "log": []})
        z["n"] += 1
        z["avg"] = math.floor((0.5 * lf + 0.5 * z["avg"]) * 1e4 + 0.5) / 1e4
        step = 0
        if z["n"] >= 2:
            step = -1 if z["avg"] < 0.65 and z["res"] > 6 else 1 if z["avg"] > 0.92 and z["res"] < 10 else 0
        if step:
            z["log"].append((z["n"], z["res"], z["res"] + step))
            z["res"] += step
    return zones


def outcomes(seed, runs=6):
    rng = random.Random(seed)
    rows = []
    for run in range(runs):
        for z in range(8):
            lf = rng.choice([0.3, 0.7, 0.95]) if z % 2 else (0.98 if z == 2 else 0.4)
            rows.append((f"r{run}", 19.1 + z * 0.3, 73.1, lf))
    return rows


OUT = "period string, pickup_lat double, pickup_lng double, load_factor double"


def state_of(df):
    return {
        r["zone_id"]: (r["resolution"], r["run_count"], r["avg_load_factor"], tuple((x["run"], x["from"], x["to"]) for x in r["adjustment_log"]))
        for r in df.collect()
    }


def test_fold_equals_sequential_learning_and_can_be_cut_anywhere(spark):
    rows = outcomes(1)
    df = spark.createDataFrame(rows, OUT)
    samples = learning.zone_samples(df)
    want = fold([(r["zone_id"], r["run"], r["sample_lf"]) for r in samples.collect()])
    whole = learning.record_run(df)
    assert state_of(whole) == {z: (v["res"], v["n"], v["avg"], tuple(v["log"])) for z, v in want.items()}
    first = learning.record_run(df.filter("period < 'r3'"))
    assert state_of(learning.record_run(df.filter("period >= 'r3'"), first)) == state_of(whole)
    assert any(v["log"] for v in want.values()) and any(v["res"] == 10 for v in want.values())


def test_reset_keeps_the_resolution(spark):
    state = learning.record_run(spark.createDataFrame(outcomes(2), OUT))
    zone = state.filter("size(adjustment_log) > 0").first()["zone_id"]
    one = {r["zone_id"]: r for r in learning.reset_zones(state, zone).collect()}
    assert one[zone]["run_count"] == 0 and one[zone]["adjustment_log"] == [] and sum(r["run_count"] == 0 for r in one.values()) == 1
    every = learning.reset_zones(state)
    assert [r["resolution"] for r in every.orderBy("zone_id").collect()] == [r["resolution"] for r in state.orderBy("zone_id").collect()]
    again = learning.record_run(spark.createDataFrame([("r9", 19.1, 73.1, 0.5)], OUT), every)
    assert again.filter("run_count = 1").first()["avg_load_factor"] == 0.25
    assert learning.zone_history(state, zone).count() == 1


def test_stream_equals_batch_and_replays_once(spark, tmp_path):
    rows = outcomes(3)
    src = str(tmp_path / "in")
    for run in sorted({r[0] for r in rows}):
        spark.createDataFrame([r for r in rows if r[0] == run], OUT).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(OUT).option("maxFilesPerTrigger", 1).parquet(src)
    store = ZoneStore(spark, str(tmp_path / "zones"))
    q = learn_from_stream(stream, store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert state_of(store.read()) == state_of(learning.record_run(spark.createDataFrame(rows, OUT)))
    before = store.versions()
    learn_from_stream(stream, store, str(tmp_path / "cp2")).awaitTermination(120)
    assert store.versions() == before


@pytest.fixture(scope="module")
def run(spark):
    return run_plan(spark, spark.createDataFrame(make_rows(200, 31, 3, 3), SCHEMA), (PRESETS[0], PRESETS[2]))


def test_features_equal_brute_force(spark, run):
    trucks = run.trucks.filter("scenario_id = 'balanced'")
    items = {r["truck_id"]: r["items"] for r in trucks.collect()}
    for f in feasibility.feature_table(trucks).collect():
        g = items[f["truck_id"]]
        far = lambda s: max((hav(a[f"{s}_lat"], a[f"{s}_lng"], b[f"{s}_lat"], b[f"{s}_lng"]) for a in g for b in g), default=0)
        assert f["pickup_spread_km"] == pytest.approx(far("pickup"), abs=1e-6)
        assert f["delivery_spread_km"] == pytest.approx(far("delivery"), abs=1e-6)
        n = len(g)
        assert f["goods_diversity"] == pytest.approx((len({x["goods_type"] for x in g}) - 1) / (n - 1) if n > 1 else 0)
        assert f["time_window_overlap_h"] == pytest.approx(max(0, min(x["latest_s"] for x in g) - max(x["earliest_s"] for x in g)) / 3600)
        assert f["max_detour_ratio"] >= 0 and (n > 1 or f["max_detour_ratio"] == 0)


def test_trees_learn_and_need_twenty_trucks(spark, run):
    features = feasibility.feature_table(run.trucks.filter("scenario_id = 'balanced'")).persist()
    assert feasibility.retrain(features.limit(10)) is None
    model = feasibility.retrain(features, max_iter=5)
    scored = feasibility.score(features, model)
    assert scored.filter("feasibility_score < 0 OR feasibility_score > 1").count() == 0
    assert set(feasibility.importances(model)) == set(feasibility.FEATURES)
    assert feasibility.score(features, None).filter("feasibility_reason IS NULL").count() == 0
    assert feasibility.synthetic_training(spark).groupBy("label").count().count() == 2


def test_comparison_and_savings(spark, run):
    table = {r["scenario_id"]: r for r in recommend(compare(run)).collect()}
    assert table["balanced"]["recommended"] and not table["baseline"]["recommended"]
    assert table["baseline"]["trips_saved"] == 0 and table["baseline"]["cost_saving_pct"] == pytest.approx(0, abs=0.1)
    assert table["balanced"]["n_trucks"] < table["baseline"]["n_trucks"]
    report = metrics.full_report(run, truck_shipments(run.trucks)).filter("scenario_id = 'balanced'").first()
    assert report["stages"]["trucks_dispatched"] == table["balanced"]["n_trucks"]
    assert sum(x["trucks"] for x in report["distribution"]) == table["balanced"]["n_trucks"]


def test_missed_partners_equal_all_pairs(spark):
    rng = random.Random(12)
    pts = [(f"p{i}", 8 + rng.random() * 26, 70 + rng.random() * 20) for i in range(150)]
    rows = []
    for i, (name, lat, lng) in enumerate(pts):
        rows.append((name, "k", lat, lng, 12.0 + (i % 3) * 0.5, 77.0))
        if i % 2:
            rows.append((name + "x", "k", lat + rng.uniform(-0.6, 0.6), lng + rng.uniform(-0.7, 0.7), 12.2, 77.0 + rng.uniform(0, 1.5)))
    df = spark.createDataFrame(rows, "shipment_id string, k string, pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double")
    want = {
        a[0] for a in rows if any(a[0] != b[0] and hav(*a[2:4], *b[2:4]) <= 60 and hav(*a[4:], *b[4:]) <= 100 for b in rows)
    }
    got = {r["shipment_id"] for r in proximity.missed_partners(df, ["k"]).filter("missed").collect()}
    assert got == want and 0 < len(want) < len(rows)
    near = proximity.pairs_within(spark.createDataFrame(pts, "place string, lat double, lng double"), 150.0)
    assert {(r["a"], r["b"]) for r in near.collect()} == {
        (a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and hav(*a[1:], *b[1:]) <= 150
    }


@pytest.mark.parametrize("box_rows", [1, 3, 64])
def test_missed_partners_of_crowded_cells(spark, monkeypatch, box_rows):
    """Crowds a little under and over the limits away from lone shipments, in cells that are halved down to a few rows."""
    monkeypatch.setattr(proximity, "BOX_ROWS", box_rows)
    rng = random.Random(box_rows)
    rows = []
    for i in range(260):
        crowd = i % 3
        plat, dlat = 19.0 + crowd * 0.9, 13.0 + crowd * 0.3
        rows.append((f"C{i:03d}", "k", plat + rng.uniform(0, 0.3), 73.0 + rng.uniform(0, 0.3), dlat + rng.uniform(0, 0.5), 80.0 + rng.uniform(0, 0.5)))
    for i in range(60):
        rows.append((f"L{i:03d}", "k", 19.0 + rng.uniform(-0.9, 3.0), 73.0 + rng.uniform(-0.9, 0.9), 13.0 + rng.uniform(-1.4, 2.0), 80.0 + rng.uniform(-1.4, 1.4)))
    df = spark.createDataFrame(rows, "shipment_id string, k string, pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double")
    near = lambda a, b: hav(a[2], a[3], b[2], b[3]) <= 60 and hav(a[4], a[5], b[4], b[5]) <= 100
    want = {a[0] for a in rows if any(a is not b and near(a, b) for b in rows)}
    flagged = proximity.missed_partners(df, ["k"])
    got = {r["shipment_id"] for r in flagged.filter("missed").collect()}
    assert got == want and flagged.count() == len(rows)
    assert 0 < len([r for r in rows if r[0] not in want]) < 60
