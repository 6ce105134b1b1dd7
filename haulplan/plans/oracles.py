"""The same answers as plain SQL, for the registered queries SQL can state."""

from __future__ import annotations

from ..operators.places import CITY_BOXES
from ..sources.fleet import BY_PAYLOAD, FLEET, LARGEST
from ..sources.shipments import DESTINATIONS, GOODS, HUBS


def rnd(x: str, digits: int = 0) -> str:
    return f"(floor(({x}) * 1e{digits} + 5e-1) / 1e{digits})"


def hav(a: str, b: str, c: str, d: str) -> str:
    inner = (
        f"pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
        f" * pow(sin(radians(({d}) - ({b})) / 2), 2)"
    )
    return f"(12742e0 * asin(sqrt(least(1e0, greatest(0e0, {inner})))))"


def road(a, b, c, d) -> str:
    return f"({hav(a, b, c, d)} * 135e-2)"


def bear(a, b, c, d) -> str:
    east = f"sin(radians(({d}) - ({b}))) * cos(radians({c}))"
    north = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))"
    return f"((degrees(atan2({east}, {north})) + 360e0) % 360e0)"


def gap(x: str, y: str) -> str:
    return f"least(abs({x} - {y}), 360e0 - abs({x} - {y}))"


def values(rows, alias: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {text}) AS {alias}"


def pick(values, index: str) -> str:
    """An element of a short fixed list."""
    text = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in values)
    return f"([{text}])[CAST({index} AS BIGINT) + 1]"


_HUB, _DST = "l_suppkey % 10", "o_custkey % 12"
# materialised and without joins to literal tables, so that no plan depends on their estimated sizes
SHIP = f"""ship AS MATERIALIZED (
 SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-',
               CAST(l_suppkey AS VARCHAR), '-', CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS shipment_id,
  {pick([h[1] for h in HUBS], _HUB)} + CAST(l_partkey % 121 - 60 AS DOUBLE) / 1000e0 AS pickup_lat,
  {pick([h[2] for h in HUBS], _HUB)} + CAST((l_suppkey * 7 + l_linenumber) % 121 - 60 AS DOUBLE) / 1000e0 AS pickup_lng,
  {pick([d[1] for d in DESTINATIONS], _DST)} + CAST(o_custkey % 141 - 70 AS DOUBLE) / 1000e0 AS delivery_lat,
  {pick([d[2] for d in DESTINATIONS], _DST)} + CAST((o_custkey * 3 + l_linenumber) % 141 - 70 AS DOUBLE) / 1000e0 AS delivery_lng,
  l_quantity * CASE WHEN l_linenumber = 7 THEN 450e0 ELSE 180e0 END + CAST(p_size * 10 AS DOUBLE) AS weight_kg,
  CAST(60 + (p_partkey * 37) % 460 AS INT) AS length_cm,
  CAST(50 + (p_partkey * 17) % 160 AS INT) AS width_cm,
  CAST(40 + (p_partkey * 29) % 150 AS INT) AS height_cm,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS ship_week,
  CAST(CAST(date_trunc('week', l_shipdate) AS DATE) AS VARCHAR) AS period,
  CAST(360 + (l_partkey * 13 + l_linenumber * 41) % 600 AS INT) AS earliest_min,
  CAST(480 + (l_partkey * 13 + l_linenumber * 41) % 600 + (l_suppkey * 11) % 121 AS INT) AS latest_min,
  {pick(GOODS, "p_partkey % 8")} AS goods_type, {pick([h[0] for h in HUBS], _HUB)} AS pickup_hub, {pick([d[0] for d in DESTINATIONS], _DST)} AS delivery_hub
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

E = ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng")

PAIRS = SHIP + """,
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ship_week, pickup_hub ORDER BY weight_kg DESC, shipment_id) AS rn FROM ship) WHERE rn = 1),
pairs AS (SELECT a.shipment_id AS a_id, a.pickup_lat AS a_plat, a.pickup_lng AS a_plng, a.delivery_lat AS a_dlat, a.delivery_lng AS a_dlng, a.delivery_hub AS a_place,
  b.shipment_id AS b_id, b.pickup_lat AS b_plat, b.pickup_lng AS b_plng, b.delivery_lat AS b_dlat, b.delivery_lng AS b_dlng, b.delivery_hub AS b_place
 FROM ship b JOIN anchor a ON a.ship_week = b.ship_week AND a.pickup_hub = b.pickup_hub AND a.shipment_id <> b.shipment_id)"""
AE = ("a_plat", "a_plng", "a_dlat", "a_dlng")
BE = ("b_plat", "b_plng", "b_dlat", "b_dlng")


def legs(dist, table: str, out: str) -> str:
    """CTE with the legs of both drop orders from the midpoint origin."""
    o = ("(a_plat + b_plat) / 2", "(a_plng + b_plng) / 2")
    return (
        f"{out} AS (SELECT *, {dist(*o, 'a_dlat', 'a_dlng')} AS to_a, {dist(*o, 'b_dlat', 'b_dlng')} AS to_b, "
        f"{dist('a_dlat', 'a_dlng', 'b_dlat', 'b_dlng')} AS between_km FROM {table})"
    )


OFFSET = (
    "CASE WHEN greatest(to_a, to_b) <= 0 THEN 0e0 ELSE greatest((least(to_a, to_b) + between_km - greatest(to_a, to_b)) / greatest(to_a, to_b), 0e0) END"
)
R1 = "CASE WHEN to_b > 0 THEN (to_a + between_km) / to_b ELSE 1e0 END"
R2 = "CASE WHEN to_a > 0 THEN (to_b + between_km) / to_a ELSE 1e0 END"
ORDER = f"CASE WHEN {rnd(R1, 9)} <= {rnd(R2, 9)} THEN 'anchor_first' ELSE 'rider_first' END"
RATIO = f"least({R1}, {R2})"


def percent(x: str) -> str:
    return f"printf('%.0f', {rnd(f'({x}) * 100e0', 0)}) || '%'"


REASON = (
    "CASE WHEN a_place = b_place THEN 'exact_lane' "
    f"WHEN {rnd('between_km', 6)} <= 50 THEN 'dest_cluster_' || printf('%.0f', {rnd('between_km', 0)}) || 'km' "
    f"WHEN {rnd('detour', 6)} <= 2e-1 THEN 'corridor_detour_' || {percent('detour')} END"
)
REVIEW = (
    "CASE WHEN reason = 'exact_lane' THEN false WHEN starts_with(reason, 'dest_cluster_') THEN between_km > 25 "
    "WHEN starts_with(reason, 'corridor_detour_') THEN detour > 1e-1 ELSE true END"
)


def bucket(lat: str, lng: str) -> str:
    return f"printf('%.1f_%.1f', round_even({lat} / 2e-1, 0) * 2e-1, round_even({lng} / 2e-1, 0) * 2e-1)"


def city(lat: str, lng: str) -> str:
    cases = " ".join(
        f"WHEN {lat} BETWEEN {a}::DOUBLE AND {b}::DOUBLE AND {lng} BETWEEN {c}::DOUBLE AND {d}::DOUBLE THEN '{name}'"
        for name, a, b, c, d in CITY_BOXES
    )
    return f"CASE {cases} END"


PLACED = SHIP + f""",
placed AS (SELECT *, coalesce({city(*E[:2])}, {bucket(*E[:2])}) AS pickup_place, coalesce({city(*E[2:])}, {bucket(*E[2:])}) AS delivery_place,
 CASE WHEN {city(*E[:2])} IS NULL THEN 'bucket' ELSE 'city' END AS pickup_source,
 CASE WHEN {city(*E[2:])} IS NULL THEN 'bucket' ELSE 'city' END AS delivery_source FROM ship)"""

FLEET_CTE = "fleet AS (SELECT * FROM " + values(
    [
        (i, v.name, v.vehicle_no, v.truck_class, float(v.max_kg), float(v.cost_per_km), float(v.l), float(v.w), float(v.h),
         float(v.fixed_cost_per_trip), v.co2_per_km_kg, v.co2_per_ton_km, v.hold_cm3)
        for i, v in enumerate(BY_PAYLOAD)
    ],
    "f(pos, name, vno, cls, max_kg, cpk, l, w, h, fix, ckm, ctk, hold)",
) + ")"

BEST = SHIP + f""", {FLEET_CTE},
load AS (SELECT *, {rnd(road(*E), 1)} AS km, CAST(length_cm AS DOUBLE) * CAST(width_cm AS DOUBLE) * CAST(height_cm AS DOUBLE) AS cm3 FROM ship),
fit AS (SELECT s.*, f.*, 6e-1 * least(weight_kg / max_kg, 1e0) + 4e-1 * least(cm3 / hold, 1e0) AS lf
 FROM load s JOIN fleet f ON f.max_kg >= s.weight_kg),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY CASE WHEN cm3 <= hold THEN 0 ELSE 1 END,
  CASE WHEN lf >= 72e-2 THEN 0 ELSE 1 END, CASE WHEN lf >= 72e-2 THEN (fix + cpk * km) / weight_kg ELSE -lf END, pos) AS rn FROM fit) WHERE rn = 1)"""

# a box fits upright goods on their longest side, floor-only goods lying flat
_LONG = "greatest(length_cm, width_cm, height_cm)"
_FLAT = "least(length_cm, width_cm, height_cm)"


def _shape(a, b, c, extra="true") -> str:
    return f"({a} <= l AND {b} <= w AND {c} <= h AND {extra})"


_D = ("length_cm", "width_cm", "height_cm")
_ALL = [(a, b, c) for a in _D for b in _D for c in _D if len({a, b, c}) == 3]
_ANY = " OR ".join(_shape(*s) for s in _ALL)
_UP = " OR ".join(_shape(*s, f"{s[2]} = {_LONG}") for s in _ALL)
_LOW = (
    f"CASE WHEN height_cm = {_FLAT} THEN {_shape(*_D)} "
    f"WHEN width_cm = {_FLAT} THEN {_shape('length_cm', 'height_cm', 'width_cm')} "
    f"ELSE {_shape('width_cm', 'height_cm', 'length_cm')} END"
)
SOLO = BEST + f""",
boxed AS (SELECT *, CASE WHEN goods_type IN ('pharma_medical', 'chemicals_industrial') THEN ({_UP})
  WHEN goods_type IN ('steel_metal_parts', 'construction_material') THEN {_LOW} ELSE ({_ANY}) END AS placed FROM best),
used AS (SELECT *, CASE WHEN placed THEN cm3 ELSE least(cm3 * 12e-1, hold * 95e-2) END AS used_cm3 FROM boxed),
solo AS (SELECT *, {rnd('weight_kg', 2)} AS kg, {rnd('6e-1 * least(weight_kg / max_kg, 1e0) + 4e-1 * least(used_cm3 / hold, 1e0)', 3)} AS load_factor,
  {rnd('least(weight_kg / max_kg, 1e0)', 3)} AS weight_util, {rnd('least(used_cm3 / hold, 1e0)', 3)} AS volume_util,
  {rnd('used_cm3 / hold', 3)} AS spatial_util, {rnd('fix + cpk * km', 0)} AS cost_inr,
  {rnd('(ckm + ctk * (weight_kg / 1000e0)) * km', 2)} AS co2_kg, pickup_hub || ' → ' || delivery_hub AS lane FROM used)"""


def mean3(c: str) -> str:
    return f"(CAST(sum(CAST(round({c} * 1000) AS BIGINT)) AS DOUBLE) / count({c}) / 1000e0)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {rnd(f'CAST({part} AS DOUBLE) / {whole} * 100e0', 1)} ELSE 0e0 END"


def zone(lat: str, lng: str, res: int, step: str) -> str:
    return f"printf('grid_%.3f_%.3f_r{res}', floor({lat} / {step}) * {step} + 0e0, floor({lng} / {step}) * {step} + 0e0)"


STEPS = {6: "1e0", 7: "5e-1", 8: "25e-2", 9: "1e-1", 10: "5e-2"}

SAMPLES = SOLO + f""",
samples AS (SELECT {zone(*E[:2], 8, STEPS[8])} AS zone_id, period AS run, {mean3('load_factor')} AS sample_lf, count(*) AS shipments
 FROM solo WHERE load_factor >= 1e-2 GROUP BY 1, 2)"""

_AVG = rnd("5e-1 * sample_lf + 5e-1 * prev", 4)
ZONES = SAMPLES.replace("ship AS", "RECURSIVE ship AS", 1) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY run) AS rn FROM samples),
fold AS (
 SELECT zone_id, rn, run, 8 AS resolution, {rnd('5e-1 * sample_lf + 5e-1 * sample_lf', 4)} AS avg, {rnd('sample_lf', 4)} AS last,
  0 AS adjustments, CAST(NULL AS INT) AS adjusted_run, CAST(NULL AS VARCHAR) AS reason FROM ranked WHERE rn = 1
 UNION ALL
 SELECT zone_id, rn, run, CASE WHEN low THEN resolution - 1 WHEN high THEN resolution + 1 ELSE resolution END, avg, last,
  adjustments + CASE WHEN low OR high THEN 1 ELSE 0 END, CASE WHEN low OR high THEN CAST(rn AS INT) ELSE adjusted_run END,
  CASE WHEN low THEN 'low_load_factor (avg=' || printf('%.2f', {rnd('avg', 2)}) || ' < 0.65)'
       WHEN high THEN 'high_load_factor (avg=' || printf('%.2f', {rnd('avg', 2)}) || ' > 0.92)' ELSE reason END
 FROM (SELECT *, avg < 65e-2 AND resolution > 6 AS low, avg > 92e-2 AND resolution < 10 AS high FROM
  (SELECT r.zone_id, r.rn, r.run, f.resolution, {_AVG.replace('prev', 'f.avg').replace('sample_lf', 'r.sample_lf')} AS avg, {rnd('r.sample_lf', 4)} AS last,
    f.adjustments, f.adjusted_run, f.reason FROM fold f JOIN ranked r ON r.zone_id = f.zone_id AND r.rn = f.rn + 1) x) y
),
zones AS (SELECT * FROM (SELECT *, max(rn) OVER (PARTITION BY zone_id) AS top FROM fold) WHERE rn = top)"""

_NEAR = (
    "EXISTS (SELECT 1 FROM singles t WHERE t.ship_week = s.ship_week AND t.shipment_id <> s.shipment_id "
    f"AND {rnd(hav('s.pickup_lat', 's.pickup_lng', 't.pickup_lat', 't.pickup_lng'), 6)} <= 60 "
    f"AND {rnd(hav('s.delivery_lat', 's.delivery_lng', 't.delivery_lat', 't.delivery_lng'), 6)} <= 100)"
)

STATS = SHIP + f""",
lane AS (SELECT ship_week, pickup_hub, delivery_hub, count(*) AS n,
  CAST(sum(CAST(round(pickup_lat * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS plat, CAST(sum(CAST(round(pickup_lng * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS plng,
  CAST(sum(CAST(round(delivery_lat * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS dlat, CAST(sum(CAST(round(delivery_lng * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS dlng
 FROM ship GROUP BY ALL)"""

FEATURES = SOLO + f""",
feat AS (SELECT shipment_id AS truck_id, 1e0 AS n, weight_kg AS total, weight_kg / 22000e0 AS wf, 0e0 AS spread, 0e0 AS detour,
  CAST(latest_min - earliest_min AS DOUBLE) * 60 / 3600e0 AS hours, km, load_factor FROM solo),
scored AS (SELECT *, {rnd("greatest(0e0, least(1e0, CASE WHEN wf > 8e-1 THEN greatest(s0, 55e-2) ELSE s0 END))", 3)} AS score FROM
 (SELECT *, 5e-1 + (wf - 5e-1) * 6e-1 - least(25e-2, spread / 40e0) - least(2e-1, detour * 5e-1) - least(15e-2, spread / 600e0) + least(1e-1, hours / 12e0) + 0e0 AS s0 FROM feat) q)"""

PROBE = """probe AS (SELECT event_id,
 CASE user_id % 50 WHEN 1 THEN NULL WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 'infinity'::DOUBLE ELSE CAST(event_id * 7 % 4000 AS DOUBLE) / 20e0 - 100e0 END AS lat,
 CASE user_id % 50 WHEN 4 THEN NULL WHEN 5 THEN 'nan'::DOUBLE WHEN 6 THEN '-infinity'::DOUBLE ELSE CAST(event_id * 13 % 8000 AS DOUBLE) / 20e0 - 200e0 END AS lng
 FROM events)"""

_CLOCK = "printf('%02d:%02d:00', {m} // 60, {m} % 60)"
FEED = SHIP + f""",
feed0 AS (SELECT *, CAST(ship_week AS VARCHAR) || 'T' || {_CLOCK.format(m='earliest_min')} AS e_txt, CAST(ship_week AS VARCHAR) || 'T' || {_CLOCK.format(m='latest_min')} AS l_txt FROM ship),
feed AS (SELECT shipment_id, CASE WHEN length_cm % 50 <> 0 THEN pickup_lat END AS pickup_lat, CASE WHEN height_cm % 31 = 0 THEN 'nan'::DOUBLE ELSE weight_kg END AS weight_kg,
  CASE WHEN width_cm % 41 = 0 THEN l_txt WHEN length_cm % 37 = 0 THEN 'soon' ELSE e_txt END AS earliest_delivery,
  CASE WHEN width_cm % 41 = 0 THEN e_txt ELSE l_txt END AS latest_delivery FROM feed0)"""

_RIGHT = "latest_min * 60 - 1800"
GROUPS = SHIP.replace("ship AS", "RECURSIVE ship AS", 1) + f""",
starts AS (SELECT period, pickup_hub, delivery_hub, earliest_min * 60 AS e, min({_RIGHT}) AS r FROM ship GROUP BY ALL),
ends AS (SELECT *, min(r) OVER (PARTITION BY period, pickup_hub, delivery_hub ORDER BY e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stab,
  row_number() OVER (PARTITION BY period, pickup_hub, delivery_hub ORDER BY e) AS i FROM starts),
jump AS (SELECT a.period, a.pickup_hub, a.delivery_hub, a.i, a.e, a.stab, min(b.i) AS nxt FROM ends a LEFT JOIN ends b
  ON a.period = b.period AND a.pickup_hub = b.pickup_hub AND a.delivery_hub = b.delivery_hub AND b.e > a.stab GROUP BY ALL),
heads AS (SELECT * FROM jump WHERE i = 1 UNION ALL
  SELECT j.* FROM heads h JOIN jump j ON j.period = h.period AND j.pickup_hub = h.pickup_hub AND j.delivery_hub = h.delivery_hub AND j.i = h.nxt)"""


# shipments whose window group has no other member
SINGLES = GROUPS + """,
member AS MATERIALIZED (SELECT s.*, h.i AS grp FROM heads h JOIN ship s ON s.period = h.period AND s.pickup_hub = h.pickup_hub AND s.delivery_hub = h.delivery_hub
  AND s.earliest_min * 60 >= h.e AND s.earliest_min * 60 <= h.stab),
singles AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY period, pickup_hub, delivery_hub, grp) AS mates FROM member) WHERE mates = 1)"""


def manifest_sql() -> str:
    return (
        f"WITH {SOLO} SELECT shipment_id, name AS vehicle_name, cls AS vehicle_class, kg AS weight_kg, load_factor, weight_util, volume_util, "
        "spatial_util, km AS route_km, cost_inr, co2_kg, "
        "printf('%02d:%02d', earliest_min // 60 % 24, earliest_min % 60) AS dispatch_from, "
        "printf('%02d:%02d', latest_min // 60 % 24, latest_min % 60) AS dispatch_to, "
        "true AS axle_balance_ok, cm3 > 79380000 AS convoy, "
        "CAST(CASE WHEN placed THEN 1 ELSE 0 END AS INT) AS stacking_layers, period FROM solo"
    )


def explanation_sql() -> str:
    return f"""WITH {FEATURES} SELECT truck_id, CASE WHEN score >= 7e-1 THEN 'HIGH' WHEN score >= 5e-1 THEN 'MEDIUM' ELSE 'LOW (singleton)' END
 || ' feasibility (' || {percent('score')} || ') — ' || concat_ws(', ',
  CASE WHEN wf >= 75e-2 THEN 'high weight fill (' || {percent('wf')} || ')' WHEN wf < 45e-2 THEN 'low weight fill (' || {percent('wf')} || ')' END,
  'tight bearing alignment (0.0°)', 'direct route (single stop)', 'tight delivery cluster (0 km)',
  CASE WHEN hours < 3 THEN 'short time overlap (' || printf('%.1f', {rnd('hours', 1)}) || 'h)' END,
  'singleton — no consolidation partner') AS feasibility_reason FROM scored"""


_POOL = "(VALUES " + ", ".join(f"('{v.name}')" for v in FLEET) + ") AS n(name)"
_SAVE = f"""WITH {SOLO}, t AS (SELECT count(*) AS trips, CAST(sum(CAST(round(cost_inr * 100) AS BIGINT)) AS DOUBLE) / 100e0 AS ccost, CAST(sum(CAST(round(co2_kg * 100) AS BIGINT)) AS DOUBLE) / 100e0 AS cco2,
 CAST(sum(CAST(round(({float(LARGEST.fixed_cost_per_trip)!r}::DOUBLE + {float(LARGEST.cost_per_km)!r}::DOUBLE * km) * 10000) AS BIGINT)) AS DOUBLE) / 10000e0 AS cost,
 CAST(sum(CAST(round(({LARGEST.co2_per_km_kg!r}::DOUBLE + {LARGEST.co2_per_ton_km!r}::DOUBLE * (weight_kg / 1000e0)) * km * 10000) AS BIGINT)) AS DOUBLE) / 10000e0 AS co2 FROM solo)
SELECT trips AS solo_trips, trips AS consolidated_trips, {big('0')} AS trips_saved, 0e0 AS trip_reduction_pct, {rnd('cost')} AS solo_cost_inr,
 {rnd('ccost')} AS cons_cost_inr, {rnd('cost - ccost')} AS cost_saved_inr, {pct('(cost - ccost)', 'cost')} AS cost_saving_pct, {rnd('co2', 1)} AS solo_co2_kg,
 {rnd('cco2', 1)} AS cons_co2_kg, {rnd('co2 - cco2', 1)} AS co2_saved_kg, {pct('(co2 - cco2)', 'co2')} AS co2_saving_pct FROM t"""


# lone shipments meet in the hours in which a common window of half an hour may begin
CANDIDATES = SINGLES + f""",
hourly AS MATERIALIZED (SELECT ship_week, pickup_hub, shipment_id AS id, pickup_lat AS plat, pickup_lng AS plng, delivery_lat AS dlat, delivery_lng AS dlng, delivery_hub AS place, weight_kg AS kg,
  earliest_min AS e, latest_min AS t, unnest(range(earliest_min // 60, (latest_min - 30) // 60 + 1)) AS hour FROM singles),
pairs AS MATERIALIZED (SELECT a.id AS a_id, a.plat AS a_plat, a.plng AS a_plng, a.dlat AS a_dlat, a.dlng AS a_dlng, a.place AS a_place,
  b.id AS b_id, b.plat AS b_plat, b.plng AS b_plng, b.dlat AS b_dlat, b.dlng AS b_dlng, b.place AS b_place,
  least(a.t, b.t) - greatest(a.e, b.e) AS overlap_min, a.kg + b.kg AS combined_kg
 FROM hourly a JOIN hourly b ON a.ship_week = b.ship_week AND a.pickup_hub = b.pickup_hub AND a.hour = b.hour
 WHERE a.place < b.place AND a.kg + b.kg <= 22000 AND least(a.t, b.t) - greatest(a.e, b.e) >= 30 AND greatest(a.e, b.e) // 60 = a.hour),
{legs(hav, 'pairs', 'legs')}, d AS (SELECT *, {OFFSET} AS detour FROM legs), r AS (SELECT *, {REASON} AS reason FROM d),
candidate AS (SELECT * FROM r WHERE reason IS NOT NULL)"""

ORACLES = {
    "haversine": f"WITH {SHIP} SELECT shipment_id, {rnd(hav(*E), 3)} AS direct_km, {rnd(road(*E), 3)} AS road_km FROM ship",
    "bearing": f"WITH {SHIP} SELECT shipment_id, {rnd(bear(*E), 3)} AS bearing_deg FROM ship",
    "bearing_diff_pairs": f"WITH {PAIRS} SELECT a_id, b_id, {rnd(gap(bear(*AE), bear(*BE)), 3)} AS bearing_gap FROM pairs",
    "detour_offset_pairs": f"WITH {PAIRS}, {legs(hav, 'pairs', 'legs')} SELECT a_id, b_id, {rnd(OFFSET, 6)} AS detour FROM legs",
    "detour_multiplier_pairs": f"WITH {PAIRS}, {legs(road, 'pairs', 'legs')} SELECT a_id, b_id, {rnd(RATIO, 6)} AS detour_ratio, {ORDER} AS drop_order FROM legs",
    "coord_verdict": f"""WITH {PROBE} SELECT event_id, CASE WHEN lat IS NULL OR lng IS NULL THEN 'missing' WHEN isnan(lat) OR isnan(lng) THEN 'nan'
 WHEN isinf(lat) OR isinf(lng) THEN 'infinite' WHEN NOT lat BETWEEN -90 AND 90 THEN 'latitude out of range' WHEN NOT lng BETWEEN -180 AND 180 THEN 'longitude out of range'
 WHEN NOT (lat BETWEEN 6 AND 38 AND lng BETWEEN 68 AND 98) THEN 'outside region' ELSE 'ok' END AS verdict FROM probe""",
    "coord_bucket": f"WITH {SHIP} SELECT shipment_id, {bucket(*E[:2])} AS pickup_bucket, {bucket(*E[2:])} AS delivery_bucket FROM ship",
    "bbox_place": f"""WITH {PLACED} SELECT shipment_id, pickup_place, pickup_source, delivery_place, delivery_source, pickup_place || ' → ' || delivery_place AS lane,
 pickup_source = 'bucket' OR delivery_source = 'bucket' AS degraded_place FROM placed""",
    "grid_zone": f"WITH {SHIP} SELECT shipment_id, " + ", ".join(f"{zone(*E[:2], r, s)} AS zone_r{r}" for r, s in STEPS.items()) + " FROM ship",
    "box_volume": f"""WITH {SHIP}, b AS (SELECT shipment_id, nullif(length_cm, width_cm) AS l, width_cm AS w, nullif(height_cm, width_cm) AS h FROM ship)
SELECT shipment_id, CAST(coalesce(l, 0) * w * coalesce(h, 0) AS DOUBLE) AS route_cm3, CAST(coalesce(l, 1) * w * coalesce(h, 1) AS DOUBLE) AS pack_cm3 FROM b""",
    "required_rows": f"WITH {FEED} SELECT shipment_id, weight_kg, earliest_delivery FROM feed WHERE pickup_lat IS NOT NULL AND NOT isnan(weight_kg)",
    "window_validity": f"""WITH {FEED}, p AS (SELECT *, try_cast(earliest_delivery AS TIMESTAMP) AS e, try_cast(latest_delivery AS TIMESTAMP) AS l FROM feed)
SELECT shipment_id, CASE WHEN pickup_lat IS NULL OR isnan(weight_kg) THEN 'missing_required' WHEN e IS NULL OR l IS NULL THEN 'bad_time' WHEN e >= l THEN 'empty_window' ELSE 'ok' END AS verdict FROM p""",
    "route_compat_pairs": f"""WITH {PAIRS}, {legs(hav, 'pairs', 'legs')}, d AS (SELECT *, {OFFSET} AS detour FROM legs), r AS (SELECT *, {REASON} AS reason FROM d)
SELECT a_id, b_id, coalesce(reason, 'incompatible') AS reason, reason IS NOT NULL AS compatible, reason IS NOT NULL AND ({REVIEW}) AS review FROM r""",
    "travel_compat_pairs": f"""WITH {PAIRS}, {legs(road, 'pairs', 'legs')}, m AS (SELECT *, {road(*AE)} AS a_km, {road(*BE)} AS b_km, {gap(bear(*AE), bear(*BE))} AS g, {RATIO} AS ratio, {ORDER} AS drop_order FROM legs)
SELECT a_id, b_id, {rnd('g', 3)} AS bearing_gap, {rnd('ratio', 6)} AS detour_ratio, drop_order, CASE WHEN {rnd('a_km', 6)} < 20 AND {rnd('b_km', 6)} < 20 THEN 'short_haul'
 WHEN {rnd('g', 9)} > 45 THEN 'bearing' WHEN {rnd('ratio', 9)} > 125e-2 THEN 'detour' ELSE 'ok' END AS verdict FROM m""",
    "corridor_candidates": f"WITH {CANDIDATES} SELECT a_id, b_id, reason, {REVIEW} AS needs_review, overlap_min, combined_kg FROM candidate",
    "place_pairs_within_radius": f"""WITH {PLACED}, c AS (SELECT pickup_place AS place, CAST(sum(CAST(round(pickup_lat * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS lat,
  CAST(sum(CAST(round(pickup_lng * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS lng FROM placed GROUP BY 1)
SELECT a.place AS a, b.place AS b, {rnd(hav('a.lat', 'a.lng', 'b.lat', 'b.lng'), 3)} AS km FROM c a JOIN c b ON a.place < b.place WHERE {rnd(hav('a.lat', 'a.lng', 'b.lat', 'b.lng'), 6)} <= 50""",
    "lane_overlap_partners": f"""WITH {SHIP} SELECT s.shipment_id, {big('count(t.shipment_id)')} AS lane_mates,
 {big('count(*) FILTER (t.shipment_id IS NOT NULL AND least(s.latest_min, t.latest_min) > greatest(s.earliest_min, t.earliest_min))')} AS overlapping,
 {big('count(*) FILTER (t.shipment_id IS NOT NULL AND least(s.latest_min, t.latest_min) <= greatest(s.earliest_min, t.earliest_min))')} AS apart
FROM ship s LEFT JOIN ship t ON s.ship_week = t.ship_week AND s.pickup_hub = t.pickup_hub AND s.delivery_hub = t.delivery_hub AND s.shipment_id <> t.shipment_id GROUP BY s.shipment_id""",
    "missed_singletons": f"WITH {SINGLES} SELECT shipment_id FROM singles s WHERE {_NEAR}",
    "unavoidable_singletons": f"WITH {SINGLES} SELECT shipment_id FROM singles s WHERE NOT {_NEAR}",
    "singleton_share": f"""WITH {SINGLES}, f AS (SELECT {_NEAR} AS missed FROM singles s), c AS (SELECT count(*) AS n, count(*) FILTER (missed) AS m FROM f)
SELECT n AS singletons, m AS missed, {rnd('CAST(n - m AS DOUBLE) / n * 100e0')} AS unavoidable_pct, 100e0 - {rnd('CAST(n - m AS DOUBLE) / n * 100e0')} AS missed_pct FROM c""",
    "vehicle_fit": f"""WITH {SHIP}, {FLEET_CTE}, m AS (SELECT shipment_id, name, pos, hold >= CASE WHEN cm3 > {LARGEST.hold_cm3!r}::DOUBLE THEN least(cm3 * 5e-1, {LARGEST.hold_cm3!r}::DOUBLE) ELSE cm3 END AS both_ok
 FROM (SELECT shipment_id, weight_kg, CAST(length_cm AS DOUBLE) * width_cm * height_cm * CASE WHEN length_cm % 7 = 0 THEN 8 ELSE 1 END AS cm3 FROM ship) JOIN fleet ON max_kg >= weight_kg),
 k AS (SELECT *, bool_or(both_ok) OVER (PARTITION BY shipment_id) AS any_both FROM m), g AS (SELECT shipment_id, count(*) AS n, string_agg(name, ';' ORDER BY pos) AS v FROM k WHERE both_ok OR NOT any_both GROUP BY 1)
SELECT s.shipment_id, CAST(coalesce(n, 0) AS INT) AS n_fits, coalesce(v, '') AS vehicles FROM ship s LEFT JOIN g ON g.shipment_id = s.shipment_id""",
    "best_vehicle": f"WITH {BEST} SELECT s.shipment_id, coalesce(name, 'OVERSIZE') AS vehicle FROM ship s LEFT JOIN best b ON s.shipment_id = b.shipment_id",
    "solo_manifest": manifest_sql(),
    "truck_listing": f"WITH {SOLO} SELECT shipment_id AS truck_id, name AS assigned_vehicle, load_factor, kg AS group_weight_kg FROM solo ORDER BY load_factor DESC, truck_id",
    "oversize_exceptions": f"WITH {SHIP} SELECT shipment_id, period, weight_kg, true AS oversize, 'OVERSIZE' AS assigned_vehicle FROM ship WHERE weight_kg > 22000",
    "vehicle_numbers": f"""WITH {BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY period, name ORDER BY substr(md5(shipment_id), 1, 3), shipment_id) AS k FROM best)
SELECT shipment_id AS truck_id, name AS assigned_vehicle, CASE WHEN k = 1 THEN vno ELSE name || '-OVF-' || CAST(k AS VARCHAR) END AS assigned_vehicle_no FROM r""",
    "pool_status": f"""WITH {BEST}, u AS (SELECT period, name, count(*) AS busy FROM best GROUP BY ALL), p AS (SELECT DISTINCT period FROM best)
SELECT p.period, n.name, greatest(coalesce(busy, 0), 1) AS total, coalesce(busy, 0) AS busy, greatest(coalesce(busy, 0), 1) - coalesce(busy, 0) AS available
FROM p CROSS JOIN {_POOL} LEFT JOIN u ON u.period = p.period AND u.name = n.name""",
    "stop_list": f"""WITH {SHIP} SELECT shipment_id AS truck_id, 1 AS stop_no, 'pickup' AS kind, shipment_id, pickup_lat AS lat, pickup_lng AS lng FROM ship WHERE weight_kg <= 22000
UNION ALL SELECT shipment_id, 2, 'delivery', shipment_id, delivery_lat, delivery_lng FROM ship WHERE weight_kg <= 22000""",
    "truck_flags": f"""WITH {SOLO} SELECT shipment_id AS truck_id, CASE WHEN load_factor >= 7e-1 THEN 'good' WHEN load_factor >= 5e-1 THEN 'moderate' ELSE 'low' END AS band,
 CASE WHEN load_factor < 4e-1 THEN 'low util' ELSE '' END AS tags, load_factor < 45e-2 AS defer FROM solo""",
    "lane_centroids": f"""WITH {STATS} SELECT ship_week, pickup_hub, delivery_hub, n, {rnd('plat', 6)} AS plat, {rnd('plng', 6)} AS plng, {rnd('dlat', 6)} AS dlat, {rnd('dlng', 6)} AS dlng,
 {rnd(bear('plat', 'plng', 'dlat', 'dlng'), 3)} AS corridor_bearing FROM lane""",
    "lane_route_stats": f"""WITH {STATS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ship_week, pickup_hub, delivery_hub ORDER BY weight_kg DESC, shipment_id) AS rn FROM ship) WHERE rn = 1),
 pairs AS (SELECT b.ship_week, b.pickup_hub, b.delivery_hub, a.shipment_id AS a_id, b.shipment_id AS b_id, a.pickup_lat AS a_plat, a.pickup_lng AS a_plng, a.delivery_lat AS a_dlat, a.delivery_lng AS a_dlng,
  b.pickup_lat AS b_plat, b.pickup_lng AS b_plng, b.delivery_lat AS b_dlat, b.delivery_lng AS b_dlng FROM ship b JOIN a ON a.ship_week = b.ship_week AND a.pickup_hub = b.pickup_hub AND a.delivery_hub = b.delivery_hub),
 {legs(road, 'pairs', 'legs')}, m AS (SELECT g.*, CASE WHEN a_id <> b_id THEN {RATIO} END AS ratio, {road(*BE)} AS km, {gap(bear(*BE), bear('plat', 'plng', 'dlat', 'dlng'))} AS gap
  FROM legs g JOIN lane l ON l.ship_week = g.ship_week AND l.pickup_hub = g.pickup_hub AND l.delivery_hub = g.delivery_hub)
SELECT ship_week, pickup_hub, delivery_hub, count(*) AS n, {rnd('sqrt(avg(gap * gap))', 3)} AS bearing_spread, {rnd('coalesce(max(ratio), 1e0)', 4)} AS max_detour_ratio,
 {rnd('sum(km)', 2)} AS total_road_km, {rnd('avg(km)', 2)} AS avg_road_km, count(*) >= 3 AND max({rnd('gap', 9)}) <= 45 AS is_corridor FROM m GROUP BY ship_week, pickup_hub, delivery_hub""",
    "utilization": f"""WITH {SOLO} SELECT count(*) AS trucks, {rnd(mean3('load_factor'), 3)} AS avg_load_factor, {rnd(mean3('weight_util'), 3)} AS avg_weight_utilization,
 {rnd(mean3('volume_util'), 3)} AS avg_volume_utilization, {rnd(mean3('spatial_util'), 3)} AS avg_spatial_utilization, sum(cost_inr) AS total_cost_inr,
 {rnd('CAST(sum(CAST(round(co2_kg * 100) AS BIGINT)) AS DOUBLE) / 100e0', 2)} AS total_co2_kg FROM solo""",
    "vehicle_mix": f"WITH {BEST} SELECT name AS assigned_vehicle, count(*) AS trucks FROM best GROUP BY 1",
    "lane_efficiency": f"""WITH {SOLO} SELECT lane, count(*) AS shipments, count(*) AS trucks, {rnd(mean3('load_factor') + ' * 100e0', 1)} AS avg_load_factor, {rnd('sum(kg)')} AS total_weight_kg,
 sum(cost_inr) AS cost_inr, {rnd('CAST(sum(CAST(round(co2_kg * 100) AS BIGINT)) AS DOUBLE) / 100e0', 1)} AS co2_kg, 0e0 AS consolidation_rate FROM solo GROUP BY lane""",
    "lf_histogram": f"""WITH {SOLO}, b AS (SELECT * FROM (VALUES ('Under 40%', -1e0, 40e0), ('40-60%', 40e0, 60e0), ('60-80%', 60e0, 80e0), ('80%+', 80e0, 1e9)) AS b(bucket, lo, hi))
SELECT bucket, count(shipment_id) AS trucks FROM b LEFT JOIN solo ON load_factor * 100e0 >= lo AND load_factor * 100e0 < hi GROUP BY bucket""",
    "lf_bands": f"""WITH {SOLO} SELECT CASE WHEN load_factor >= 7e-1 THEN 'good' WHEN load_factor >= 5e-1 THEN 'moderate' ELSE 'low' END AS band, count(*) AS trucks,
 count(*) FILTER (load_factor < 45e-2) AS deferral_recommended, count(*) FILTER (load_factor < 4e-1) AS low_util FROM solo GROUP BY 1""",
    "consolidation_summary": f"""WITH {SHIP}, n AS (SELECT count(*) AS n FROM ship WHERE weight_kg <= 22000) SELECT n AS n_shipments, n AS n_trucks, n AS n_singletons, {big('0')} AS n_batched_groups,
 {big('0')} AS n_batched_shipments, {big('0')} AS exact_lane_groups, {big('0')} AS corridor_groups, 0e0 AS trip_reduction_pct, {big('0')} AS trips_saved FROM n""",
    "goods_summary": f"WITH {SHIP} SELECT goods_type, count(*) AS shipments, {rnd('sum(weight_kg)')} AS total_kg, {rnd('sum(weight_kg) / count(*)')} AS avg_kg FROM ship GROUP BY 1",
    "reach_by_quarter": f"""WITH {SHIP}, q AS (SELECT *, CAST(year(ship_week) AS VARCHAR) || '-' || CAST(quarter(ship_week) AS VARCHAR) AS quarter,
 {big('round(delivery_lat * 1000)')} AS y, {big('round(delivery_lng * 1000)')} AS x FROM ship)
SELECT pickup_hub, quarter, count(DISTINCT delivery_hub) AS destinations, count(DISTINCT (y, x)) AS delivery_points, count(DISTINCT shipment_id) AS shipments,
 true AS destinations_told, true AS delivery_points_told, true AS shipments_told FROM q GROUP BY pickup_hub, quarter""",
    "input_kpis": f"""WITH {SHIP} SELECT count(*) AS shipments, count(DISTINCT pickup_hub) AS origin_hubs, count(DISTINCT delivery_hub) AS destinations, {rnd('sum(weight_kg) / 1000e0', 1)} AS total_tonnes FROM ship""",
    "lane_distribution": f"""WITH {SHIP} SELECT pickup_hub || ' → ' || delivery_hub AS lane, count(*) AS shipments, count(*) FILTER (weight_kg < 8000) AS ltl,
 {rnd('CAST(count(*) FILTER (weight_kg < 8000) AS DOUBLE) / count(*) * 100e0', 1)} AS ltl_pct FROM ship GROUP BY 1""",
    "top_lanes": f"""WITH {SHIP} SELECT pickup_hub || ' → ' || delivery_hub AS lane, count(*) AS shipments, count(*) FILTER (weight_kg < 8000) AS ltl,
 {rnd('CAST(count(*) FILTER (weight_kg < 8000) AS DOUBLE) / count(*) * 100e0', 1)} AS ltl_pct FROM ship GROUP BY 1 ORDER BY shipments DESC, lane LIMIT 10""",
    "hub_fanout": f"WITH {SHIP} SELECT pickup_hub, count(*) AS shipments, count(DISTINCT delivery_hub) AS destinations FROM ship GROUP BY 1 HAVING count(*) >= 3",
    "wave_distribution": f"""WITH {SHIP} SELECT pickup_hub, CASE WHEN earliest_min < 360 THEN 'night' WHEN earliest_min < 720 THEN 'morning' WHEN earliest_min < 1020 THEN 'afternoon' ELSE 'evening' END AS wave,
 count(*) AS shipments FROM ship GROUP BY 1, 2""",
    "solo_savings": _SAVE,
    "heaviest_anchor": f"""WITH {SHIP}, w AS (SELECT ship_week, pickup_hub, shipment_id, weight_kg, row_number() OVER (PARTITION BY ship_week, pickup_hub ORDER BY weight_kg DESC, shipment_id) AS a,
 row_number() OVER (PARTITION BY ship_week, pickup_hub ORDER BY latest_min, shipment_id) AS d FROM ship)
SELECT ship_week, pickup_hub, max(CASE WHEN a = 1 THEN shipment_id END) AS anchor_id, max(weight_kg) AS anchor_kg, max(CASE WHEN d = 1 THEN shipment_id END) AS first_deadline_id FROM w GROUP BY 1, 2""",
    "overlap_islands": f"""WITH {SHIP}, o AS (SELECT period, pickup_hub, delivery_hub, earliest_min * 60 AS e, {_RIGHT} AS r,
  max({_RIGHT}) OVER (PARTITION BY period, pickup_hub, delivery_hub ORDER BY earliest_min RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ship),
 s AS (SELECT *, dense_rank() OVER (PARTITION BY period, pickup_hub, delivery_hub ORDER BY e) AS k, CASE WHEN e > reach THEN 1 ELSE 0 END AS opens FROM o),
 d AS (SELECT DISTINCT period, pickup_hub, delivery_hub, e, opens FROM s),
 i AS (SELECT *, sum(opens) OVER (PARTITION BY period, pickup_hub, delivery_hub ORDER BY e) AS island FROM d)
SELECT s.period, s.pickup_hub, s.delivery_hub, CAST(island AS INT) AS island, count(*) AS shipments, {big('min(s.e)')} AS from_s, {big('max(s.r)')} AS to_s
FROM s JOIN i ON s.period = i.period AND s.pickup_hub = i.pickup_hub AND s.delivery_hub = i.delivery_hub AND s.e = i.e GROUP BY ALL""",
    "window_groups": f"""WITH {GROUPS} SELECT s.period, s.pickup_hub, s.delivery_hub, {big('min(s.earliest_min) * 60')} AS first_start_s, count(*) AS shipments, sum(s.weight_kg) AS weight_kg,
 {big('(min(s.latest_min) - max(s.earliest_min)) * 60')} AS common_s FROM heads h JOIN ship s ON s.period = h.period AND s.pickup_hub = h.pickup_hub AND s.delivery_hub = h.delivery_hub
 AND s.earliest_min * 60 >= h.e AND s.earliest_min * 60 <= h.stab GROUP BY s.period, s.pickup_hub, s.delivery_hub, h.i""",
    "zone_samples": f"WITH {SAMPLES} SELECT zone_id, run, {rnd('sample_lf', 6)} AS sample_lf, shipments FROM samples",
    "zone_ema": f"""WITH {ZONES} SELECT zone_id, CAST(resolution AS INT) AS resolution, CAST(rn AS INT) AS run_count, avg AS avg_load_factor, last AS last_load_factor, run AS last_run,
 CAST(adjustments AS INT) AS adjustments, adjusted_run, reason FROM zones""",
    "zone_summary": f"""WITH {ZONES} SELECT count(*) AS zones_tracked, {big('sum(rn)')} AS total_observations, count(*) FILTER (adjustments > 0) AS zones_auto_adjusted,
 {rnd('avg(avg) FILTER (avg > 1e-2)', 3)} AS global_avg_load_factor, count(*) FILTER (adjustments > 0) > 0 AS learning_active FROM zones""",
    "resolution_histogram": f"WITH {ZONES} SELECT CAST(resolution AS INT) AS resolution, count(*) AS zones FROM zones GROUP BY 1",
    "improved_zones": f"""WITH {ZONES} SELECT zone_id, CAST(adjustments AS INT) AS adjustments_made, avg AS current_lf, CAST(resolution AS INT) AS current_res FROM zones WHERE adjustments > 0 AND avg > 65e-2""",
    "zone_lookup": f"""WITH {ZONES}, z AS (SELECT DISTINCT {zone(*E[2:], 8, STEPS[8])} AS zone_id FROM ship)
SELECT z.zone_id, CAST(coalesce(resolution, 8) AS INT) AS resolution, resolution IS NOT NULL AS known FROM z LEFT JOIN zones ON zones.zone_id = z.zone_id""",
    "solo_features": f"""WITH {FEATURES} SELECT truck_id, n AS n_shipments, {rnd('total', 4)} AS total_weight_kg, {rnd('wf', 4)} AS weight_fraction, 0e0 AS bearing_spread_deg, 0e0 AS max_detour_ratio,
 0e0 AS delivery_spread_km, 0e0 AS pickup_spread_km, {rnd('total', 4)} AS avg_weight_per_ship, {rnd('hours', 4)} AS time_window_overlap_h, 0e0 AS goods_diversity, {rnd('km', 4)} AS route_km, 0e0 AS is_corridor,
 CASE WHEN load_factor >= 6e-1 THEN 1e0 ELSE 0e0 END AS label FROM feat""",
    "rule_score": f"WITH {FEATURES} SELECT truck_id, score AS feasibility_score FROM scored",
    "rule_explanation": explanation_sql(),
    "feasibility_bands": f"""WITH {FEATURES} SELECT count(*) FILTER (score >= 7e-1) AS high, count(*) FILTER (score >= 5e-1 AND score < 7e-1) AS medium, count(*) FILTER (score < 5e-1) AS low,
 {rnd('avg(score)', 3)} AS avg_score FROM scored""",
    "map_layer": f"""WITH {SOLO} SELECT shipment_id AS truck_id, name AS assigned_vehicle, lane AS group_lane, {', '.join(f'{rnd(c, 6)} AS {c}' for c in E)},
 CAST(greatest(2, floor(load_factor * 6)) AS INT) AS line_weight, CAST(('0x' || substr(md5(shipment_id), 1, 4))::INT % 15 AS INT) AS colour FROM solo""",
}
