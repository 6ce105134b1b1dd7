import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import model
from haulplan.functions import geo_np
from haulplan.operators.clusters import sweep
from haulplan.operators.loading import Hold, load_truck, orientations
from haulplan.operators.payload import first_fit_runs
from haulplan.operators.regroup import next_fit
from haulplan.operators.route import plan_batch, stop_order
from haulplan.operators.windows import stab_groups


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 120), min_size=1, max_size=60))
def test_first_fit_by_counts_equals_item_by_item(sizes):
    sizes.sort(reverse=True)
    want, load = [], []
    for s in sizes:
        b = next((i for i, x in enumerate(load) if x + s <= 100), None)
        if b is None:
            load.append(0)
            b = len(load) - 1
        load[b] += s
        want.append(b)
    classes = sorted(set(sizes), reverse=True)
    got = {}
    for c, rank, items, first, per in first_fit_runs(classes, [sizes.count(x) for x in classes], 100):
        for k in range(items):
            got[(classes[c], rank + k)] = first + k // per
    seen = {}
    for s, b in zip(sizes, want):
        k = seen[s] = seen.get(s, -1) + 1
        assert got[(s, k)] == b


def test_first_fit_with_many_runs():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 220) for _ in range(4000)), reverse=True)
    classes = sorted(set(sizes), reverse=True)
    pieces = first_fit_runs(classes, [sizes.count(x) for x in classes], 220)
    load, bins = {}, []
    for s in sizes:
        b = next((i for i, x in enumerate(bins) if x + s <= 220), None)
        if b is None:
            bins.append(0)
            b = len(bins) - 1
        bins[b] += s
    for c, _, items, first, per in pieces:
        for k in range(items):
            load[first + k // per] = load.get(first + k // per, 0) + classes[c]
    assert [load[i] for i in range(len(load))] == bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(5, 40)), min_size=1, max_size=40))
def test_stabbing_equals_greedy_window_grouping(windows):
    rows = [{"id": f"{i:03d}", "e": e, "l": e + d} for i, (e, d) in enumerate(windows)]
    want = [{s["id"] for s in g} for g in model.window_groups(rows, 5)]
    starts = sorted({s["e"] for s in rows})
    right = [min(s["l"] - 5 for s in rows if s["e"] == t) for t in starts]
    number = dict(zip(starts, stab_groups(starts, right).tolist()))
    got = {}
    for s in rows:
        got.setdefault(number[s["e"]], set()).add(s["id"])
    assert [got[k] for k in sorted(got)] == want


def test_sweep_equals_pairwise_model():
    rng = random.Random(5)
    for _ in range(200):
        members = {
            f"p{i:02d}": [(18 + rng.random() * 3, 72 + rng.random() * 3)] * rng.randint(1, 5) for i in range(rng.randint(1, 12))
        }
        names = sorted(members)
        sums = [[round(sum(p[k] for p in members[n]) * 1e6) for n in names] for k in (0, 1)]
        got = dict(zip(names, sweep(names, [len(members[n]) for n in names], *sums, 60.0)))
        assert got == model.merge_places(members, 60.0)


def test_next_fit_needs_only_first_and_last_of_a_full_group():
    rng = random.Random(8)
    for _ in range(300):
        full, short = [], []
        for k in range(rng.randint(1, 6)):
            e = k * rng.randint(1, 4)
            # more than half a truck each: no two of one group fit together
            group = sorted((rng.randint(11_000_001, 20_000_000) if rng.random() < 0.5 else 0 for _ in range(rng.randint(1, 5))), reverse=True)
            group = [u for u in group if u] or [rng.randint(2_000_000, 20_000_000)]
            rows = [(u, e, e + 10) for u in group]
            full += rows
            short += rows if len(rows) < 3 else [rows[0], rows[-1]]
        bins = lambda rows: sorted(
            tuple(r for r, b in zip(rows, got) if b == x) for got in [next_fit(*zip(*rows), 2)] for x in set(got)
        )
        many = lambda rows: [b for b in bins(rows) if len(b) > 1]
        assert many(full) == many(short)


def test_stop_order():
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 8, 12):
        pts = [(rng.random() * 5 + 15, rng.random() * 5 + 73) for _ in range(n)]
        km = lambda i, j: 1.35 * model.hav(*pts[i], *pts[j])
        due = [rng.randint(0, 50) for _ in range(n)]
        tour = stop_order(list(range(n)), due, km)
        assert sorted(tour) == list(range(n))
        if n <= 2:
            assert tour == list(range(n))
        else:
            assert due[tour[0]] == min(due)
            assert stop_order(list(range(n)), due, km, closed=False)[0] == tour[0]
        if n == 12:
            left, at = set(range(n)) - {tour[0]}, tour[0]
            for nxt in tour[1:]:
                assert km(at, nxt) == min(km(at, x) for x in left)
                left.remove(nxt)
                at = nxt


def test_large_group_is_whole_beside_a_small_one():
    rng = np.random.default_rng(1)
    n = 90
    args = [rng.random(n) * s + o for s, o in ((0.1, 19), (0.1, 73), (3, 18), (3, 74))]
    kw = dict(volume=[[1.0] * n], deadline=[list(range(n))], bearing_limit=[45.0], detour_limit=[1.25])
    (many,) = plan_batch(*[[a] for a in args], **kw)
    both = plan_batch(*[[a[:5], a] for a in args], [[1.0] * 5, *kw["volume"]], [list(range(5)), *kw["deadline"]], [45.0] * 2, [1.25] * 2)
    assert both[1] == many and sorted(i for r in many for i in r) == list(range(n))


def test_numpy_geometry_matches_scalars():
    rng = random.Random(4)
    for _ in range(100):
        p = [rng.uniform(8, 30), rng.uniform(70, 90), rng.uniform(8, 30), rng.uniform(70, 90)]
        assert geo_np.haversine_km(*p) == pytest.approx(model.hav(*p), abs=1e-9)
        assert geo_np.bearing_deg(*p) == pytest.approx(model.bearing(*p), abs=1e-9)
    assert geo_np.bearing_diff(350.0, 10.0) == 20.0


def test_orientations():
    assert orientations(3, 2, 1, False, False) == [(3, 2, 1), (3, 1, 2), (2, 3, 1), (2, 1, 3), (1, 3, 2), (1, 2, 3)]
    assert orientations(3, 2, 1, True, False) == [(2, 1, 3), (1, 2, 3)]
    assert orientations(3, 2, 1, False, True) == [(3, 2, 1)]
    assert orientations(3, 2, 1, True, False, rotate=False) == [(3, 2, 1)]


def test_boxes_stay_inside_and_apart():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 25)
        boxes = sorted(
            ([rng.randint(20, 300), rng.randint(20, 200), rng.randint(20, 180)] for _ in range(n)), key=lambda b: -math.prod(b)
        )
        l, w, h = zip(*boxes)
        kg = [rng.randint(50, 900) for _ in boxes]
        top = [rng.choice([0.0, 500.0, 15000.0]) for _ in boxes]
        placed, used, _ = load_truck(l, w, h, kg, [rng.random() < 0.3 for _ in boxes], top, (975, 245, 240, 16000))
        solid = [(p, k, t) for p, k, t in zip(placed, kg, top) if not p[6]]
        for (x, y, z, a, b, c, _), _, _ in solid:
            assert x + a <= 975 and y + b <= 245 and z + c <= 240
        for i, (p, kp, tp) in enumerate(solid):
            for q, kq, tq in solid[i + 1 :]:
                apart = any(p[k] + p[k + 3] <= q[k] + 1e-9 or q[k] + q[k + 3] <= p[k] + 1e-9 for k in range(3))
                assert apart, (p, q)
                if p[2] < q[2]:
                    assert kq <= tp
                if q[2] < p[2]:
                    assert kp <= tq
        assert used <= sum(math.prod(b) for b in boxes) * 1.2 + 1e-6


def test_loose_geometry_keeps_boxes_as_given():
    hold = Hold(100.0, 50.0, 50.0, 1000.0, strict=False)
    assert hold.add(60, 30, 20, 10, False, 15000.0, rotate=False) == (0.0, 0.0, 0.0, 60, 30, 20, False)
    # a second box of the same height no longer fits above a started shelf's top plus itself
    assert hold.add(60, 20, 20, 10, False, 15000.0, rotate=False) == (0.0, 20.0, 0.0, 60, 20, 20, False)
    assert hold.add(10, 10, 45, 10, False, 15000.0, rotate=False)[6] is True
