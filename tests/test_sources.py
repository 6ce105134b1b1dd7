import datetime as dt

import pytest
from pyspark.sql import functions as F

import model
from haulplan.operators.places import CITY_BOXES, assign_places
from haulplan.operators.validate import coord_error, csv_planning_rows, split_valid, window_seconds
from haulplan.plans.dispatch import run_plan, truck_shipments
from haulplan.plans.params import custom_scenario, scenarios_df
from haulplan.operators.vehicles import manifest, vehicle_numbers
from haulplan.operators import metrics
from haulplan.sources import fleet, generator, place_cache
from haulplan.sources.place_store import PlaceStore
from haulplan.sources.shipments import read_shipments_csv
from haulplan.sources.sinks import write_report

HEADER = "shipment_id,pickup_lat,pickup_lng,delivery_lat,delivery_lng,weight_kg,length_cm,width_cm,height_cm,earliest_delivery,latest_delivery,goods_type,pickup_hub,delivery_hub,note"


def test_csv_keeps_good_rows_and_names_the_reason_for_the_rest(spark, tmp_path):
    good = "SH{},19.3,73.06,18.52,73.86,{},100,90,80,{},{},electronics,A,B,x"
    t = ("2024-01-15T06:00:00", "2024-01-15T09:00:00")
    lines = [
        HEADER,
        good.format(1, 900.5, *t),
        good.format(2, "", *t),
        good.format(3, 900, "soon", t[1]),
        good.format(4, 900, t[1], t[0]),
        good.format(5, 900, "", t[1]),
        good.format(6, "heavy", *t),
        good.format(7, -3, *t),
        good.format(8, 900, *t).replace("18.52", "NaN"),
        good.format(9, 900, t[0], t[0]),
    ]
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    df = window_seconds(read_shipments_csv(spark, path))
    assert "note" in df.columns
    valid, rejects = split_valid(df)
    assert [r["shipment_id"] for r in valid.collect()] == ["SH1"]
    got = {r["shipment_id"]: r["reject_reason"] for r in rejects.collect()}
    assert got == {
        "SH2": "missing_required", "SH3": "bad_time", "SH4": "empty_window", "SH5": "missing_required",
        "SH6": "corrupt_record", "SH7": "bad_weight", "SH8": "bad_coordinate", "SH9": "empty_window",
    }
    rows = csv_planning_rows(valid)
    assert rows.first()["earliest_s"] == int(dt.datetime(2024, 1, 15, 6, tzinfo=dt.timezone.utc).timestamp())


def test_csv_without_a_required_column_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("shipment_id,pickup_lat\nA,1\n")
    with pytest.raises(ValueError, match="weight_kg"):
        read_shipments_csv(spark, str(tmp_path / "bad.csv"))


def test_generated_file_plans_from_end_to_end(spark, tmp_path):
    df = generator.generate_shipments(spark, 120)
    assert df.collect() == generator.generate_shipments(spark, 120).repartition(3).orderBy(F.length("shipment_id"), "shipment_id").collect()
    wide = df.filter("weight_kg * 1000000 < 100D * length_cm * width_cm * height_cm AND (length_cm > 30 OR width_cm > 30 OR height_cm > 30)")
    assert wide.count() == 0
    df.coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    valid, rejects = split_valid(window_seconds(read_shipments_csv(spark, str(tmp_path / "csv"))))
    assert rejects.count() == 0
    run = run_plan(spark, csv_planning_rows(valid))
    assert truck_shipments(run.trucks).count() == 120 and run.exceptions.count() == 0
    assert run.trucks.count() < 120
    out = manifest(vehicle_numbers(run.trucks))
    for fmt in ("parquet", "csv", "json"):
        write_report(out, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == run.trucks.count()


def test_coordinate_verdicts(spark):
    nan, inf = float("nan"), float("inf")
    pts = [(19.0, 73.0, None), (None, 1.0, "missing"), (nan, 1.0, "nan"), (1.0, inf, "infinite"), (91.0, 73.0, "latitude out of range"), (19.0, 181.0, "longitude out of range"), (5.9, 73.0, "outside region")]
    df = spark.createDataFrame(pts, "lat double, lng double, want string").withColumn("got", coord_error("lat", "lng"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_places_match_the_model_at_box_edges(spark):
    pts = []
    for _, a, b, c, d in CITY_BOXES:
        pts += [(a, c), (b, d), (b + 1e-9, d), ((a + b) / 2, (c + d) / 2), (a, d + 1e-9), (a - 0.3, c)]
    df = spark.createDataFrame([(*p, *p) for p in pts], "pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double")
    for r in assign_places(df).collect():
        assert r["pickup_place"] == r["delivery_place"] == model.place(r["pickup_lat"], r["pickup_lng"])


def test_place_cache(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    old = [(19.3, 73.06, 10, {"suburb": " ", "city": "Old"}, t(0)), (18.52, 73.86, 10, {}, t(0)), (18.52, 73.86, 8, {"district": "Pune zone"}, t(0))]
    new = [(19.3, 73.06, 10, {"industrial": "Park", "city": "Old"}, t(1))]
    cache = place_cache.upsert(spark.createDataFrame(old, place_cache.SCHEMA), spark.createDataFrame(new, place_cache.SCHEMA))
    stats = place_cache.cache_stats(cache).first().asDict()
    assert stats == {"total": 3, "populated": 2, "empty": 1, "zoom_10": 2, "zoom_8": 1}
    rows = spark.createDataFrame([(19.3001, 73.0601, 18.52, 73.86)], "pickup_lat double, pickup_lng double, delivery_lat double, delivery_lng double")
    r = assign_places(rows, cache).first()
    assert (r["pickup_place"], r["pickup_source"], r["delivery_place"], r["delivery_source"]) == ("Park", "zoom10", "Pune zone", "zoom8")
    assert not r["degraded_place"]
    kept, removed = place_cache.evict_empty(cache)
    assert kept.count() == 2 and removed.first()["removed"] == 1
    counts = place_cache.warm_up_counts(rows.union(spark.createDataFrame([(99.0, 1.0, 13.0, 80.2)], rows.schema)), cache).first().asDict()
    assert counts == {"unique_points": 4, "already_cached": 2, "to_fetch": 1, "skipped_invalid": 1}
    assert place_cache.missing_points(rows, cache).count() == 0


def test_fleet_and_scenarios(spark):
    f = fleet.fleet_df(spark)
    assert f.count() == 12 and fleet.incomplete_vehicles(f).count() == 0
    broken = f.withColumn("max_kg", F.when(F.col("fleet_ord") != 3, F.col("max_kg")))
    assert fleet.incomplete_vehicles(broken).collect()[0]["missing"] == ["max_kg"]
    assert custom_scenario(max_detour_ratio=1.3).clustering_detour == 0.3
    assert custom_scenario(max_detour_ratio=1.0).clustering_detour == 0.01
    assert scenarios_df(spark).count() == 5


def _addresses(spark, points, name, day):
    rows = [(round(a, 3), round(b, 3), 10, {"city": name}, dt.datetime(2024, 1, day)) for a, b in points]
    return spark.createDataFrame(rows, place_cache.SCHEMA)


def test_place_store_rewrites_the_touched_buckets_and_keeps_snapshots(spark, tmp_path):
    store = PlaceStore(spark, str(tmp_path / "places"), buckets=64)
    assert store.versions() == [] and store.read().count() == 0
    everywhere = [(10 + i * 0.25 + 0.01, 70 + j * 0.25 + 0.01) for i in range(40) for j in range(40)]
    assert store.upsert(_addresses(spark, everywhere, "old", 2)) == 1
    # one per cent of the keys, all of one region, and one older than the cache's own
    region = [p for p in everywhere if p[0] < 11 and p[1] < 71]
    assert store.upsert(_addresses(spark, region[1:], "new", 3).unionByName(_addresses(spark, region[:1], "late", 1))) == 2
    name = lambda version: {(r["lat3"], r["lng3"]): r["addr"]["city"] for r in store.read(version).collect()}
    key = lambda p: (round(p[0], 3), round(p[1], 3))
    assert name(1) == {key(p): "old" for p in everywhere}
    assert name(None) == {key(p): "new" if p in region[1:] else "old" for p in everywhere}
    before, after = (dict(map(tuple, store.listed(v).collect())) for v in (1, 2))
    rewritten = [b for b in after if after[b] != before.get(b)]
    assert after.keys() == before.keys() and 0 < len(rewritten) <= len(region) < len(after)
    # an upsert that never commits is not seen and does not stand in the way of the next
    store.read().write.mode("overwrite").parquet(f"{store.path}/lists/version=3/_temporary/0")
    assert store.versions() == [1, 2]
    assert store.upsert(_addresses(spark, [], "none", 4)) == 3 and name(3) == name(2)


def test_reach_of_any_range_of_periods_from_sketches(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 7).alias("period"), F.when(F.col("id") % 3 == 0, "hot").otherwise("other").alias("hub"), (F.col("id") * 7919 % 21_001).alias("place")
    )
    weekly = metrics.reach_sketches(rows, ["hub", "period"], {"places": F.col("place")}).cache()
    for first, last in ((0, 6), (2, 3), (5, 5)):
        span = F.col("period").between(first, last)
        exact = {r[0]: r[1] for r in rows.filter(span).groupBy("hub").agg(F.count_distinct("place")).collect()}
        told = {r[0]: r[1] for r in metrics.merge_reach(weekly.filter(span), ["hub"], ["places"]).collect()}
        assert told.keys() == exact.keys() and all(abs(told[h] - exact[h]) <= 4 * 1.04 / 128 * exact[h] for h in exact)
    assert metrics.merge_reach(weekly.filter("false"), ["hub"], ["places"]).count() == 0
