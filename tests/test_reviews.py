import numpy as np
from pyspark.sql import functions as F

from haulplan.operators import corridor


def test_hourly_blocks_find_every_pair_once(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        e = int(rng.integers(0, 1300))
        rows.append(("w", f"S{i:03d}", 19.0, 73.0, 20.0, 74.0, f"place{i % 9}", float(rng.integers(1, 21_999)), e, e + int(rng.integers(0, 400))))
    rows.append(("w", "T", 19.0, 73.0, 20.0, 74.0, "place0", 1.0, 60, 90))  # just long enough, on the border of an hour
    singles = spark.createDataFrame(rows, "week string, id string, plat double, plng double, dlat double, dlng double, place string, kg double, e int, t int")
    got = sorted((r.a_id, r.b_id, r.overlap_min) for r in corridor.candidate_pairs(singles, ["week"]).collect())
    want = sorted(
        (a[1], b[1], min(a[9], b[9]) - max(a[8], b[8])) for a in rows for b in rows
        if a[6] < b[6] and a[7] + b[7] <= 22_000 and min(a[9], b[9]) - max(a[8], b[8]) >= 30
    )
    assert got == want and len(got) > 100


def test_refusals_count_both_ways_and_open_ones_do_not(spark):
    rows = [("a", "b", False), ("a", "c", True), ("c", "d", None), ("b", "d", False), ("a", "b", False)]
    decisions = spark.createDataFrame(rows, "id_a string, id_b string, approved boolean")
    got = {r.shipment_id: sorted(r.refused) for r in corridor.refused_partners(decisions).collect()}
    assert got == {"a": ["b"], "b": ["a", "d"], "d": ["b"]}


def test_reviews_equal_their_sql_at_small_scale(spark):
    from compare import difference, duck
    from haulplan.plans import reviews

    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    for name in ("refused_partners", "open_candidates", "custom_compatibility", "mixed_labels", "zones_improving", "zone_log"):
        got = reviews.QUERIES[name](spark, sf)
        assert difference(got.toPandas(), con.execute(reviews.ORACLES[name]).df()) is None, name
    assert reviews.QUERIES["zones_improving"](spark, sf).count() > 0
    assert reviews.QUERIES["mixed_labels"](spark, sf).filter(F.col("cluster_lane").contains("[")).count() > 0
