"""Route filter: volume split, direction split and stop order inside a group.

Groups arrive as one row with their item list, which the payload cap bounds.
An item is tested against a whole group in one numpy call; no pairs leave the
helper, and none are kept.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import geo_np
from ..functions.geo import bearing_deg, bearing_diff, detour_multiplier, road_km
from ..functions.measures import route_volume_cm3
from ..functions.rounding import rnd

EPS_DIGITS = 9  # ratios and degrees are compared at this precision


def travel_compatibility(pairs: DataFrame, max_bearing=45.0, max_detour=1.25) -> DataFrame:
    """Verdict for given pairs; ``a`` is the anchor (heavier), ``b`` the rider."""
    a, b = ({c: F.col(f"{s}_{c}") for c in ("plat", "plng", "dlat", "dlng")} for s in "ab")
    ends = ("plat", "plng", "dlat", "dlng")
    ratio, order = detour_multiplier(a, b)
    df = pairs.withColumns(
        {
            "a_km": road_km(*[a[c] for c in ends]),
            "b_km": road_km(*[b[c] for c in ends]),
            "bearing_gap": bearing_diff(bearing_deg(*[a[c] for c in ends]), bearing_deg(*[b[c] for c in ends])),
            "detour_ratio": ratio,
            "drop_order": order,
        }
    )
    short = (rnd(F.col("a_km"), 6) < K.SHORT_HAUL_ROAD_KM) & (rnd(F.col("b_km"), 6) < K.SHORT_HAUL_ROAD_KM)
    return df.withColumn(
        "verdict",
        F.when(short, "short_haul")
        .when(rnd(F.col("bearing_gap"), EPS_DIGITS) > max_bearing, "bearing")
        .when(rnd(F.col("detour_ratio"), EPS_DIGITS) > max_detour, "detour")
        .otherwise("ok"),
    ).withColumn("compatible", F.col("verdict").isin("short_haul", "ok"))


class PairTester:
    """Travel compatibility of item pairs, vectorised over a whole batch."""

    def __init__(self, plat, plng, dlat, dlng, bearing_limit, detour_limit):
        self.p, self.d = (plat, plng), (dlat, dlng)
        self.km = geo_np.haversine_km(plat, plng, dlat, dlng) * K.ROAD_FACTOR
        self.bearing = geo_np.bearing_deg(plat, plng, dlat, dlng)
        self.bearing_limit, self.detour_limit = bearing_limit, detour_limit
        self.short = np.round(self.km, 6) < K.SHORT_HAUL_ROAD_KM

    def under(self, bearing_limit, detour_limit) -> "PairTester":
        """The same items under other limits."""
        other = copy(self)
        other.bearing_limit, other.detour_limit = bearing_limit, detour_limit
        return other

    def ends(self, i: int) -> tuple[float, float, float, float]:
        return tuple(float(x[i]) for x in (*self.p, *self.d))

    def drop_km(self, i: int, others: np.ndarray) -> np.ndarray:
        """Road km from the delivery of ``i`` to those of ``others``."""
        return geo_np.haversine_km(self.d[0][i], self.d[1][i], self.d[0][others], self.d[1][others]) * K.ROAD_FACTOR

    def measure(self, i, j):
        """(both short hauls, bearing gap, detour ratio, km between the deliveries) for index arrays i and j."""
        at = lambda pt, k: (pt[0][k], pt[1][k])
        to_i, to_j, between = geo_np.drop_legs(at(self.p, i), at(self.d, i), at(self.p, j), at(self.d, j))
        ratio = geo_np.detour_multiplier(to_i, to_j, between)
        gap = geo_np.bearing_diff(self.bearing[i], self.bearing[j])
        short = self.short[i] & self.short[j]
        return short, np.round(gap, EPS_DIGITS), np.round(ratio, EPS_DIGITS), between * K.ROAD_FACTOR

    def allows(self, i, short, gap, ratio):
        """Whether measured pairs may travel together under the limits of i."""
        return short | ((gap <= self.bearing_limit[i]) & (ratio <= self.detour_limit[i]))

    def test(self, i, j):
        """(compatible, km between the deliveries) for index arrays i and j."""
        short, gap, ratio, between = self.measure(i, j)
        return self.allows(i, short, gap, ratio), between


def volume_bins(volume, cap: float) -> list[list[int]]:
    """First-fit decreasing on volume, largest box first."""
    bins, load = [], []
    for i in sorted(range(len(volume)), key=lambda i: -volume[i]):
        for b, used in enumerate(load):
            if used + volume[i] <= cap:
                bins[b].append(i)
                load[b] += volume[i]
                break
        else:
            bins.append([i])
            load.append(volume[i])
    return bins


class BearingIndex:
    """The arcs of bearings that groups still admit, relative to their first member.

    A member admits riders up to the limit on either side, so a group admits the
    overlap of its members' arcs. Pairs of two short hauls are exempt: a short
    rider only has to suit the members that are not short. Whatever lies outside is
    surely refused; what lies inside is still tested.
    """

    _SLACK = 1e-6  # bearings are compared after rounding

    def __init__(self, limit: float):
        self.limit, self.n = limit, 0
        # up to here no arc reaches around the circle into the arc of the first member; a wider limit admits all
        self.useful = limit <= 89
        self.zero = np.zeros(16)
        self.low, self.high = np.full((2, 16), -np.inf), np.full((2, 16), np.inf)  # row 0: of all members, row 1: of the long ones

    def candidates(self, bearing: float, short: bool) -> np.ndarray:
        """Groups in order that may admit the bearing."""
        if not self.useful:
            return np.arange(self.n)
        row = int(short)
        off = (bearing - self.zero[: self.n] + 180.0) % 360.0 - 180.0
        return np.flatnonzero((off >= self.low[row, : self.n] - self._SLACK) & (off <= self.high[row, : self.n] + self._SLACK))

    def add(self, group: int, bearing: float, short: bool) -> None:
        if group == self.n:
            self.n += 1
            if self.n > self.zero.size:
                self.zero = np.concatenate([self.zero, np.zeros(self.n)])
                self.low = np.concatenate([self.low, np.full((2, self.n), -np.inf)], axis=1)
                self.high = np.concatenate([self.high, np.full((2, self.n), np.inf)], axis=1)
            self.zero[group] = bearing
        off = (bearing - self.zero[group] + 180.0) % 360.0 - 180.0
        for row in (0,) if short else (0, 1):
            self.low[row, group] = max(self.low[row, group], off - self.limit)
            self.high[row, group] = min(self.high[row, group], off + self.limit)


def travel_groups(members: list[int], tester: "PairTester", base: int = 0) -> list[list[int]]:
    """Heaviest first; each joins the first group it is compatible with throughout.

    A member is tested against a whole group in one numpy call, when the group
    may admit its bearing; no test is kept. Members that start and end alike pass
    the same tests, so a group remembers one of each.
    """
    groups: list[list[int]] = []
    kinds: list[dict] = []  # ends -> a member that has them
    arcs: list[np.ndarray] = []
    index = BearingIndex(float(tester.bearing_limit[base + members[0]])) if members else None
    for m in members:
        at = base + m
        bearing, short, ends = float(tester.bearing[at]), bool(tester.short[at]), tester.ends(at)
        for g in index.candidates(bearing, short).tolist():
            if short and tester.short[arcs[g]].all() or tester.test(arcs[g], np.full(arcs[g].size, at))[0].all():
                groups[g].append(m)
                if ends not in kinds[g]:
                    kinds[g][ends] = at
                    arcs[g] = np.append(arcs[g], at)
                break
        else:
            g = len(groups)
            groups.append([m])
            kinds.append({ends: at})
            arcs.append(np.array([at]))
        index.add(g, bearing, short)
    return groups


def stop_order(members: list[int], deadline, km, closed: bool = True, to_all=None, table=None) -> list[int]:
    """Delivery order of a group given heaviest first.

    Up to two stops keep their order. From three on: nearest neighbour from
    the earliest deadline, then 2-opt for up to eight stops. 2-opt prices the
    tour as closed unless ``closed`` is False. ``to_all`` gives the distances
    from one stop to an array of stops, for long tours; ``table`` returns rows of
    known distances, for short ones.
    """
    if len(members) <= 2:
        return members
    start = min(members, key=lambda m: deadline[m])
    tour = [start]
    if table is not None:
        rows, left = table(), [m for m in members if m != start]
        km = lambda a, b: rows[a][b]
        while left:
            tour.append(min(left, key=rows[tour[-1]].__getitem__))
            left.remove(tour[-1])
    else:
        if to_all is None:
            to_all = lambda a, others: np.array([km(a, m) for m in others.tolist()])
        rest = np.array([m for m in members if m != start], dtype=np.int64)
        while rest.size:
            nearest = int(to_all(tour[-1], rest).argmin())
            tour.append(int(rest[nearest]))
            rest = np.delete(rest, nearest)
    if len(tour) > K.TWO_OPT_MAX_STOPS:
        return tour
    size = len(tour)
    for _ in range(K.TWO_OPT_MAX_PASSES):
        better = False
        for i in range(1, size - 1):
            for j in range(i + 1, size):
                a, b, c = tour[i - 1], tour[i], tour[j]
                last = j + 1 == size and not closed
                d = tour[(j + 1) % size]
                old = km(a, b) + (0.0 if last else km(c, d))
                new = km(a, c) + (0.0 if last else km(b, d))
                if new < old - K.TWO_OPT_TOLERANCE_KM:
                    tour[i : j + 1] = reversed(tour[i : j + 1])
                    better = True
        if not better:
            break
    return tour


def bins_of(n: int, volume, cap: float) -> list[list[int]]:
    """Items of a group that one hold takes, heaviest first in each bin."""
    return [sorted(b) for b in volume_bins(volume, cap)] if sum(volume) > cap else [list(range(n))]


def split_group(n: int, volume, deadline, tester: PairTester, base: int, cap: float) -> list[list[int]]:
    """Routes of the group whose ``n`` items stand from ``base`` on in the tester."""

    def to_all(i: int, others: np.ndarray) -> np.ndarray:
        return tester.drop_km(base + i, base + others)

    def km(i: int, j: int) -> float:
        return float(to_all(i, np.array([j]))[0])

    return [
        stop_order(g, deadline, km, to_all=to_all) for b in bins_of(n, volume, cap) for g in travel_groups(b, tester, base)
    ]


SMALL_GROUP = 64  # items; all pairs of such groups are measured, many groups in one numpy call
PAIRS_AT_ONCE = 1 << 17


def measured_groups(testers: list[PairTester], offset, sizes):
    """(group, verdicts by tester and pair, km by pair) of every small group; pairs (i, j), i before j, in rows of i.

    The testers differ in their limits alone, so a pair is measured once for all.
    """
    small = [g for g, n in enumerate(sizes) if 1 < n <= SMALL_GROUP]
    corners = {n: np.triu_indices(n, 1) for n in {sizes[g] for g in small}}
    at = 0
    while at < len(small):
        some, pairs = [], 0
        while at < len(small) and pairs < PAIRS_AT_ONCE:
            some.append(small[at])
            pairs += corners[sizes[small[at]]][0].size
            at += 1
        i, j = (np.concatenate([corners[sizes[g]][side] + offset[g] for g in some]) for side in (0, 1))
        short, gap, ratio, _ = testers[0].measure(i, j)
        km = testers[0].drop_km(i, j)
        allowed = np.stack([t.allows(i, short, gap, ratio) for t in testers])
        end = np.cumsum([corners[sizes[g]][0].size for g in some]).tolist()
        for g, a, b in zip(some, [0, *end], end):
            yield g, allowed[:, a:b], km[a:b]


def first_fit(members: list[int], n: int, allowed) -> list[list[int]]:
    """``travel_groups`` from the verdicts of all pairs of a group of ``n``."""
    suits, bit = [0] * n, 0
    verdicts = allowed.tolist()
    for i in range(n):
        for j in range(i + 1, n):
            suits[j] |= verdicts[bit] << i
            bit += 1
    groups: list[list[int]] = []
    held: list[int] = []
    for m in members:
        for g, members_of in enumerate(held):
            if not members_of & ~suits[m]:
                groups[g].append(m)
                held[g] |= 1 << m
                break
        else:
            groups.append([m])
            held.append(1 << m)
    return groups


def split_small_group(n: int, volume, deadline, allowed, km, cap: float) -> list[list[list[int]]]:
    """Routes of a group, per row of ``allowed``, from the verdicts and distances of all its pairs."""
    bins, rows = bins_of(n, volume, cap), []

    def table() -> list[list[float]]:
        if not rows:
            rows.extend([0.0] * n for _ in range(n))
            pair = iter(km.tolist())
            for i in range(n):
                for j in range(i + 1, n):
                    rows[i][j] = rows[j][i] = next(pair)
        return rows

    # a distance that is not a number comes before all others, which numpy sees to
    known = None if np.isnan(km).any() else table

    out: list[list[list[int]]] = []
    same: dict[bytes, list] = {}
    ordered: dict[tuple, list[int]] = {}
    for row in allowed:
        alike = row.tobytes()
        if alike not in same:
            groups = bins if row.all() else [g for b in bins for g in first_fit(b, n, row)]
            for g in groups:
                if tuple(g) not in ordered:
                    ordered[tuple(g)] = stop_order(g, deadline, lambda i, j: table()[i][j], table=known)
            same[alike] = [ordered[tuple(g)] for g in groups]
        out.append(same[alike])
    return out


def plan_batch_under(plat, plng, dlat, dlng, volume, deadline, bearing_limits, detour_limits, cap=K.ROUTE_VOLUME_CAP_CM3):
    """Routes of every group in a batch under each of its limits: per group and limit a list of ordered positions."""
    sizes = np.array([len(x) for x in plat])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    flat = [np.concatenate([np.asarray(x, dtype=float) for x in col]) for col in (plat, plng, dlat, dlng)]
    settings = [len(x) for x in bearing_limits]

    def limit(values, k: int) -> np.ndarray:
        return np.repeat(np.array([v[min(k, len(v) - 1)] for v in values], float), sizes)

    first = PairTester(*flat, limit(bearing_limits, 0), limit(detour_limits, 0))
    testers = [first, *[first.under(limit(bearing_limits, k), limit(detour_limits, k)) for k in range(1, max(settings))]]
    out: list = [None] * len(sizes)
    for g, allowed, km in measured_groups(testers, offset, sizes.tolist()):
        out[g] = split_small_group(int(sizes[g]), list(volume[g]), list(deadline[g]), allowed[: settings[g]], km, cap)
    for g, n in enumerate(sizes.tolist()):
        if out[g] is None:
            whole = n, list(volume[g]), list(deadline[g])
            out[g] = [split_group(*whole, tester, int(offset[g]), cap) for tester in testers[: settings[g]]]
    return out


def plan_batch(plat, plng, dlat, dlng, volume, deadline, bearing_limit, detour_limit, cap=K.ROUTE_VOLUME_CAP_CM3):
    """Routes of every group in a batch: per group a list of ordered positions."""
    limits = ([[float(x)] for x in v] for v in (bearing_limit, detour_limit))
    return [routes for (routes,) in plan_batch_under(plat, plng, dlat, dlng, volume, deadline, *limits, cap)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _routes_udf(
    plat: pd.Series, plng: pd.Series, dlat: pd.Series, dlng: pd.Series,
    volume: pd.Series, deadline: pd.Series, bearing_limit: pd.Series, detour_limit: pd.Series,
) -> pd.Series:
    if not len(plat):
        return pd.Series([], dtype=object)
    return pd.Series(plan_batch(plat, plng, dlat, dlng, volume, deadline, bearing_limit, detour_limit))


_SHARED = T.StructType(
    [T.StructField("stops", T.ArrayType(T.ArrayType(T.IntegerType())))]
    + [T.StructField(f, T.ArrayType(T.ArrayType(T.IntegerType()))) for f in ("settings", "route_nos", "counts")]
)


def shared_routes(under: list[list[list[int]]]) -> tuple[list, list, list, list]:
    """The distinct routes of a group, and for each the settings that have it, its number and their number of routes there."""
    at: dict[tuple, int] = {}
    stops, settings, numbers, counts = [], [], [], []
    for k, routes in enumerate(under):
        for no, route in enumerate(routes):
            i = at.setdefault(tuple(route), len(stops))
            if i == len(stops):
                stops.append(route)
                settings.append([])
                numbers.append([])
                counts.append([])
            settings[i].append(k)
            numbers[i].append(no)
            counts[i].append(len(routes))
    return stops, settings, numbers, counts


@F.pandas_udf(_SHARED)
def _shared_routes_udf(
    plat: pd.Series, plng: pd.Series, dlat: pd.Series, dlng: pd.Series,
    volume: pd.Series, deadline: pd.Series, bearing_limits: pd.Series, detour_limits: pd.Series,
) -> pd.DataFrame:
    under = plan_batch_under(plat, plng, dlat, dlng, volume, deadline, bearing_limits, detour_limits) if len(plat) else []
    return pd.DataFrame([shared_routes(u) for u in under], columns=_SHARED.names, dtype=object)


def item_array(items: str, field: str) -> Column:
    return F.col(f"{items}.{field}")


def item_volumes(items: str, kind=route_volume_cm3) -> Column:
    return F.transform(items, lambda x: kind(x["length_cm"], x["width_cm"], x["height_cm"]))


def split_routes(groups: DataFrame, bearing_limit: Column, detour_limit: Column) -> DataFrame:
    """One row per route, items in stop order.

    ``groups``: group_id and ``items`` sorted heaviest first. Groups of one
    pass by without Python.
    """
    alone = groups.filter(F.size("items") == 1).withColumns({"route_no": F.lit(0), "routes_in_group": F.lit(1)})
    routes = _routes_udf(
        *[item_array("items", f) for f in ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng")],
        item_volumes("items"), item_array("items", "latest_s"), bearing_limit, detour_limit,
    )
    many = (
        groups.filter(F.size("items") > 1)
        .withColumn("_routes", routes)
        .withColumn("routes_in_group", F.size("_routes"))
        # the outer form adds no filter on the helper's result, which would run it twice
        .select("*", F.posexplode_outer("_routes").alias("route_no", "_stops"))
        .withColumn("items", F.expr("transform(_stops, i -> items[i])"))
        .drop("_routes", "_stops")
    )
    return alone.unionByName(many).withColumn("route_id", F.concat_ws("#", "group_id", F.col("route_no").cast("string")))


def split_routes_under(groups: DataFrame) -> DataFrame:
    """One row per distinct route of a group under any of its ``settings``, items in stop order.

    ``settings`` is an array of structs (scenario_id, bearing_limit,
    detour_limit), equal for groups of one ``scenario_id``. A route's ``uses`` tell the settings that have it:
    scenario_id, bearing_limit, route_no, routes_in_group. So what follows from
    a route's items is worked out once for all settings.
    """
    use = lambda s, no, n: F.struct(s["scenario_id"].alias("scenario_id"), s["bearing_limit"].alias("bearing_limit"), no.alias("route_no"), n.alias("routes_in_group"))
    alone = groups.filter(F.size("items") == 1).withColumns(
        {"uses": F.transform("settings", lambda s: use(s, F.lit(0), F.lit(1))), "_no": F.lit(0)}
    )
    routes = _shared_routes_udf(
        *[item_array("items", f) for f in ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng")],
        item_volumes("items"), item_array("items", "latest_s"), F.col("settings.bearing_limit"), F.col("settings.detour_limit"),
    )
    zipped = F.arrays_zip(*[F.col(f"_routes.{f}").alias(f) for f in _SHARED.names])
    each = F.arrays_zip(*[F.col(f"_r.{f}").alias(f) for f in _SHARED.names[1:]])
    many = (
        groups.filter(F.size("items") > 1)
        .withColumn("_routes", routes)
        .select("*", F.posexplode_outer(zipped).alias("_no", "_r"))
        .withColumns(
            {
                "items": F.expr("transform(_r.stops, i -> items[i])"),
                "uses": F.transform(each, lambda e: use(F.get("settings", e["settings"]), e["route_nos"], e["counts"])),
            }
        )
        .drop("_routes", "_r")
    )
    both = alone.unionByName(many)
    return both.withColumn("route_id", F.concat_ws("#", "group_id", F.col("_no").cast("string"))).drop("_no", "settings")


_END_FIELDS = ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng")


def mean_of(items: str, field: str) -> Column:
    return F.expr(f"IF(group_size = 1, 0D + {items}[0].{field}, aggregate({items}.{field}, 0D, (a, x) -> a + x) / size({items}))")


def corridor_flag(limit: Column) -> Column:
    """Three shipments or more, none further than ``limit`` off the route's bearing."""
    aligned = F.forall("items", lambda x: rnd(bearing_diff(x["route_bearing"], F.col("corridor_bearing")), EPS_DIGITS) <= limit)
    return (F.col("group_size") >= 3) & aligned


def annotate_routes(routes: DataFrame) -> DataFrame:
    """Group bearing, corridor flag and volume use; per item km, bearing, volume.

    ``group_size`` and ``group_u`` (weight units) are taken before the items
    change, unless the routes bring them: a filter on either is then cheap,
    where one on the new items would run their distances once more. A route of
    one shipment is told by plain expressions, without a lambda.
    """
    ends = lambda x: [x[f] for f in _END_FIELDS]

    def told(x: Column) -> Column:
        return (
            x.withField("route_km", rnd(road_km(*ends(x)), 1))
            .withField("route_bearing", bearing_deg(*ends(x)))
            .withField("volume_cm3", route_volume_cm3(x["length_cm"], x["width_cm"], x["height_cm"]))
        )

    sums = {"group_size": F.size("items"), "group_u": F.expr("aggregate(items.weight_u, 0L, (a, x) -> a + x)")}
    df = routes.withColumns({c: e for c, e in sums.items() if c not in routes.columns})
    alone = F.col("group_size") == 1
    df = df.withColumn("items", F.when(alone, F.array(told(F.col("items")[0]))).otherwise(F.transform("items", told)))
    df = df.withColumn("corridor_bearing", bearing_deg(*[mean_of("items", f) for f in _END_FIELDS]))
    # a route of several settings has a flag in each of its uses
    if "uses" in df.columns:
        flags = {"uses": F.transform("uses", lambda u: u.withField("is_corridor", corridor_flag(u["bearing_limit"])))}
    else:
        flags = {"is_corridor": corridor_flag(F.col("bearing_limit"))}
    total = F.when(alone, F.lit(0.0) + F.col("items")[0]["volume_cm3"]).otherwise(F.expr("aggregate(items.volume_cm3, 0D, (a, x) -> a + x)"))
    return df.withColumns(
        {
            **flags,
            "route_volume_cm3": total,
            "vol_utilisation": rnd(total / F.lit(K.ROUTE_VOLUME_CAP_CM3), 3),
            "stop_sequence": F.col("items.shipment_id"),
        }
    )


def items_in(routes: DataFrame) -> Column:
    """The number of a route's items, as its ``group_size`` tells it."""
    return F.col("group_size") if "group_size" in routes.columns else F.size("items")


def route_stats(routes: DataFrame) -> DataFrame:
    """Coherence measures per route: bearings, spread, worst detour, distances.

    A route of one shipment has no detour and is told by plain expressions, without a lambda.
    """
    def pts(x):
        return dict(zip(("plat", "plng", "dlat", "dlng"), [x[f] for f in _END_FIELDS]))

    n = items_in(routes)
    one = F.col("items")[0]
    told = lambda alone, many: F.when(n == 1, alone).otherwise(many)
    anchor = F.expr(
        "reduce(items, items[0], (m, x) -> IF(x.weight_u > m.weight_u OR "
        "(x.weight_u = m.weight_u AND x.shipment_id < m.shipment_id), x, m))"
    )
    df = routes.withColumn("_anchor", told(one, anchor))
    detours = F.transform(
        F.filter("items", lambda x: x["shipment_id"] != F.col("_anchor.shipment_id")),
        lambda x: detour_multiplier(pts(F.col("_anchor")), pts(x))[0],
    )
    gap = lambda x: F.pow(bearing_diff(x["route_bearing"], F.col("corridor_bearing")), F.lit(2.0))
    km = lambda x: road_km(*[x[f] for f in _END_FIELDS])
    add = lambda of: told(F.lit(0.0) + of(one), F.aggregate(F.transform("items", of), F.lit(0.0), lambda a, x: a + x))
    return df.withColumns(
        {
            "avg_bearing": rnd(add(lambda x: x["route_bearing"]) / n, 1),
            "bearing_spread": rnd(F.sqrt(add(gap) / n), 1),
            "max_detour_ratio": rnd(told(F.lit(1.0), F.coalesce(F.array_max(detours), F.lit(1.0))), 2),
            "total_road_km": rnd(add(km), 1),
            "avg_road_km": rnd(add(km) / n, 1),
        }
    ).drop("_anchor")


def stop_list(trucks: DataFrame) -> DataFrame:
    """All pickups, then all deliveries of a truck, in stop order."""
    def leg(kind: str, side: str):
        return F.transform(
            "items",
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x["shipment_id"].alias("shipment_id"),
                x[f"{side}_lat"].alias("lat"), x[f"{side}_lng"].alias("lng"),
            ),
        )

    stops = F.concat(leg("pickup", "pickup"), leg("delivery", "delivery"))
    return trucks.select("truck_id", F.posexplode(stops).alias("pos", "s")).select(
        "truck_id", (F.col("pos") + 1).alias("stop_no"), "s.*"
    )
