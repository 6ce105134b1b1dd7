"""Helpers that hold one group at a time, at sizes where the plain way would not do."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulplan.functions import constants as K
from haulplan.operators import loading, payload
from haulplan.operators.clusters import MICRO, sweep
from haulplan.operators.route import PairTester, plan_batch, travel_groups
from haulplan.sources.fleet import LARGEST

from model import hav, merge_places  # noqa: E402


def plain_first_fit(weights, cap):
    room, out, top = np.full(len(weights), cap), np.empty(len(weights), np.int64), 0
    for i, w in enumerate(weights):
        b = int((room[: top + 1] >= w).argmax())
        room[b] -= w
        out[i], top = b, max(top, b + 1)
    return out


def bins_of(pieces, n):
    """Bin of every shipment of weights that occur once each."""
    out = np.empty(n, np.int64)
    for c, _, items, first, _ in pieces:
        assert items == 1
        out[c] = first
    return out


def test_a_hundred_thousand_different_gram_weights():
    rng = np.random.default_rng(1)
    weights = np.sort(rng.choice(6_000_000, 100_000, replace=False) + 1)[::-1].tolist()
    assert (bins_of(payload.first_fit_runs(weights, [1] * len(weights), K.MAX_PAYLOAD_U), len(weights)) == plain_first_fit(weights, K.MAX_PAYLOAD_U)).all()


def test_a_million_different_weights_take_seconds():
    rng = np.random.default_rng(2)
    weights = np.sort(rng.choice(3_000_000, 1_000_000, replace=False) + 1)[::-1].tolist()
    start = time.time()
    bins = bins_of(payload.first_fit_runs(weights, [1] * len(weights), K.MAX_PAYLOAD_U), len(weights))
    assert time.time() - start < 120
    load = np.bincount(bins, weights=weights)
    assert load.max() <= K.MAX_PAYLOAD_U
    # the head is placed as the plain way places it, whatever comes later
    assert (bins[:30_000] == plain_first_fit(weights[:30_000], K.MAX_PAYLOAD_U)).all()
    # nobody opened a bin while an earlier one had room: an opener did not fit any earlier bin
    first = np.full(load.size, -1)
    first[bins[::-1]] = np.arange(len(weights))[::-1]
    assert (np.diff(first) > 0).all()


def test_runs_are_split_and_found_again():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = np.sort(rng.choice(300, 40, replace=False) + 1)[::-1].tolist()
        counts = rng.integers(1, 200, 40).tolist()
        flat = [s for s, n in zip(sizes, counts) for _ in range(n)]
        want, got, at = plain_first_fit(flat, 300), {}, 0
        for c, rank, items, first, per in payload.first_fit_runs(sizes, counts, 300):
            for k in range(items):
                got[c, rank + k] = first + k // per
        for c, n in enumerate(counts):
            assert [got[c, k] for k in range(n)] == want[at : at + n].tolist()
            at += n


def test_a_hot_window_is_split_like_the_plain_way(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", int(w), int(e), f"S{i:05d}") for i, (w, e) in enumerate(zip(rng.integers(1, 9_000_000, 4000), rng.integers(0, 50, 4000)))]
    rows += [(f"w{k}", 9_000_000 - k, 0, f"T{k}-{i}") for k in range(30) for i in range(5)]
    over = spark.createDataFrame(rows, "window_id string, weight_u long, earliest_s long, shipment_id string")
    got = payload.split_payload(over.repartition(5)).collect()
    assert len(got) == len(rows)
    hot = sorted((r for r in got if r.window_id == "hot"), key=lambda r: -r.weight_u)
    want = plain_first_fit([r.weight_u for r in hot], K.MAX_PAYLOAD_U)
    key = lambda pairs: sorted((w, b) for w, b in pairs)
    assert key((r.weight_u, r.bin_no) for r in hot) == key((r.weight_u, int(b)) for r, b in zip(hot, want))
    assert {(r.window_id, r.bin_no) for r in got if r.window_id == "w3"} == {("w3", 0), ("w3", 1), ("w3", 2)}
    plan = payload.split_payload(over)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


@pytest.mark.parametrize("centre", [(20.0, 76.0), (61.0, 76.0), (-3.0, -0.4), (84.0, 10.0)])
def test_the_grid_sweep_equals_the_pairwise_model(centre):
    rng = np.random.default_rng(7)
    for radius, spread, n in ((40.0, 2.0, 80), (15.0, 3.0, 150), (120.0, 1.5, 60), (0.0, 1.0, 20)):
        names = [f"p{i:03d}" for i in rng.permutation(n)]
        members = {p: [(float(a), float(b)) for a, b in np.round(rng.normal(centre, spread, (rng.integers(1, 4), 2)), 5)] for p in sorted(names)}
        members[sorted(names)[3]] = members[sorted(names)[7]]  # two places in one spot
        want = merge_places(members, radius)
        sums = [[round(sum(x[k] for x in members[p]) * MICRO) for p in sorted(names)] for k in (0, 1)]
        got = dict(zip(sorted(names), sweep(sorted(names), [len(members[p]) for p in sorted(names)], *sums, radius)))
        assert got == want


def test_a_map_full_of_places_sweeps_in_seconds():
    """Every 0.2 degree cell of the region: the bound of a place table."""
    lat, lng = np.meshgrid(np.arange(6, 38, 0.2), np.arange(68, 98, 0.2))
    names = [f"{a:.1f}_{b:.1f}" for a, b in zip(lat.ravel(), lng.ravel())]
    start = time.time()
    clusters = sweep(names, [1] * len(names), (lat.ravel() * MICRO).tolist(), (lng.ravel() * MICRO).tolist(), 30.0)
    assert len(names) == 24_000 and time.time() - start < 60 and len(set(clusters)) < len(names)


def plain_groups(members, tester):
    groups = []
    for m in members:
        for g in groups:
            if all(tester.test(np.array([x]), np.array([m]))[0][0] for x in g):
                g.append(m)
                break
        else:
            groups.append([m])
    return groups


@pytest.mark.parametrize("limit", [10.0, 45.0, 89.0, 120.0, 180.0])
def test_travel_groups_equal_all_pair_tests(limit):
    rng = np.random.default_rng(int(limit))
    for near in (0.05, 0.2, 3.0):  # degrees: short hauls only, mixed, long ones
        n = 70
        plat, plng = 19 + rng.normal(0, near / 3, n), 73 + rng.normal(0, near / 3, n)
        dlat, dlng = plat + rng.normal(0, near, n), plng + rng.normal(0, near, n)
        plat[10:20], plng[10:20], dlat[10:20], dlng[10:20] = plat[5], plng[5], dlat[5], dlng[5]
        dlat[30], dlng[30] = plat[30], plng[30]
        tester = PairTester(plat, plng, dlat, dlng, np.full(n, limit), np.full(n, 1.25))
        assert travel_groups(list(range(n)), tester) == plain_groups(list(range(n)), tester)


def test_thousands_of_parcels_in_one_group_keep_no_pairs():
    rng = np.random.default_rng(9)
    n = 4000
    start, end = rng.normal((19.0, 73.0), 0.02, (n, 2)), rng.normal((26.0, 77.0), 0.05, (n, 2))
    tracemalloc.start()
    (routes,) = plan_batch([start[:, 0]], [start[:, 1]], [end[:, 0]], [end[:, 1]], [[1.0] * n], [list(range(n))], [45.0], [1.25])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(m for r in routes for m in r) == list(range(n)) and peak < 30e6
    for route in routes:  # nearest neighbour from the earliest deadline
        assert route[0] == min(route)
        a, b = route[0], route[1]
        assert all(hav(*end[a], *end[b]) <= hav(*end[a], *end[m]) + 1e-9 for m in route[1:])


def test_clusters_of_many_periods_sweep_apart(spark):
    from haulplan.operators.clusters import origin_clusters
    from haulplan.plans.params import BALANCED

    rows = [(f"2024-01-{p:02d}", f"place{i:02d}", 1, (19 + i * 0.1 * (p % 4)) * MICRO, 73.0 * MICRO, 0, 0) for p in range(1, 9) for i in range(12)]
    lanes = spark.createDataFrame(rows, "period string, pickup_place string, n long, plat double, plng double, dlat long, dlng long")
    got = origin_clusters(lanes, (BALANCED,)).collect()
    assert len(got) == len(rows)
    for p in range(1, 9):
        members = {f"place{i:02d}": [(19 + i * 0.1 * (p % 4), 73.0)] for i in range(12)}
        want = merge_places(members, BALANCED.pickup_radius_km)
        assert {r.pickup_place: r.origin_cluster for r in got if r.period == f"2024-01-{p:02d}"} == want
    assert "collect_list" not in origin_clusters(lanes.withColumn("x", F.lit(1)), (BALANCED,))._jdf.queryExecution().toString()


def plain_nearest(index, kg, cm3):
    """The first truck with payload left of those nearest to the target, by a loop over all."""
    best, least = -1, float("inf")
    for truck in range(index.opened):
        heavy, full = index.kg[truck] + kg, index.cm3[truck] + cm3
        gap = K.FIT_SCORE_SHARE * abs(heavy / LARGEST.max_kg - K.LF_TARGET) + K.FIT_SCORE_SHARE * abs(full / LARGEST.hold_cm3 - K.LF_TARGET)
        if heavy <= LARGEST.max_kg and gap < least:
            best, least = truck, gap
    return best


@pytest.mark.parametrize("seed,light,step", [(1, 5, 1), (2, 900, 250), (3, 4000, 4000), (4, 1, 1)])
def test_the_truck_index_finds_the_truck_that_a_loop_finds(seed, light, step):
    rng = np.random.default_rng(seed)
    kgs = (rng.integers(light, 9_000, 1500) // step + 1) * float(step)
    sides = np.sort(rng.choice([20.0, 60.0, 120.0, 240.0], (1500, 3)), axis=1)
    index = loading.TruckIndex(kgs.min())
    for kg, (h, w, l) in zip(kgs.tolist(), sides[np.argsort(-sides.prod(1))].tolist()):
        want = plain_nearest(index, kg, l * w * h)
        got = index.put((l, w, h, kg, False, 1e9))
        assert got == (want if want >= 0 else index.opened - 1)
    assert index.count.sum() == len(index.holds) <= index.opened


def test_a_demand_of_two_hundred_thousand_boxes_holds_open_trucks_alone():
    rng = np.random.default_rng(5)
    n = 200_000
    kgs = rng.integers(100, 3_000, n).astype(float)
    sides = np.sort(rng.integers(20, 160, (n, 3)).astype(float), axis=1)
    index, start = loading.TruckIndex(kgs.min()), time.time()
    for kg, (h, w, l) in zip(kgs.tolist(), sides[np.argsort(-sides.prod(1))].tolist()):
        index.put((l, w, h, kg, False, 1e9))
    assert time.time() - start < 300
    assert index.kg[: index.opened].max() <= LARGEST.max_kg and index.opened < 1.5 * kgs.sum() / LARGEST.max_kg
    assert len(index.holds) < index.opened / 2
