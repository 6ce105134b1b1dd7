"""Volumes, costs, load factors, labels and texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.fleet import BY_PAYLOAD, LARGEST
from . import constants as K
from .rounding import rnd


def side(col, default: int) -> Column:
    """A box side in cm; missing or zero counts as ``default``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.nullif(c.cast("double"), F.lit(0.0)), F.lit(float(default)))


def route_volume_cm3(l, w, h) -> Column:
    """Box volume for the route filter: a missing side makes it 0."""
    return side(l, 0) * side(w, 0) * side(h, 0)


def pack_volume_cm3(l, w, h) -> Column:
    """Box volume for packing: a missing side counts as 1 cm."""
    return side(l, 1) * side(w, 1) * side(h, 1)


def weight_units(kg) -> Column:
    """Kilograms as whole grams, rounded up so that a truck is never overloaded.

    At least one unit, so the payload also bounds the pieces on a truck.
    """
    return F.greatest(F.ceil(kg * F.lit(float(K.WEIGHT_UNITS_PER_KG)) - F.lit(1e-6)), F.lit(1)).cast("long")


def lookup(key: Column, values: dict, default) -> Column:
    """A CASE over a short fixed table."""
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def vehicle_attr(name: Column, attr: str) -> Column:
    """An attribute of the named vehicle type; null when there is none."""
    return lookup(name, {v.name: getattr(v, attr) for v in BY_PAYLOAD}, None)


def trip_cost(fixed, per_km, km) -> Column:
    return fixed + per_km * km


def co2_kg(per_km, per_ton_km, kg, km) -> Column:
    return (per_km + per_ton_km * (kg / F.lit(1000.0))) * km


def load_factor(weight_ratio, space_ratio) -> Column:
    return F.lit(K.LF_WEIGHT_SHARE) * F.least(weight_ratio, F.lit(1.0)) + F.lit(
        K.LF_SPACE_SHARE
    ) * F.least(space_ratio, F.lit(1.0))


def fleet_literal() -> str:
    """The fleet as a literal SQL array, smallest payload first."""
    rows = (
        f"named_struct('pos', {i}, 'name', '{v.name}', 'kg', {float(v.max_kg)}D, 'cm3', {v.hold_cm3}D, "
        f"'fix', {float(v.fixed_cost_per_trip)}D, 'per_km', {float(v.cost_per_km)}D)"
        for i, v in enumerate(BY_PAYLOAD)
    )
    return f"array({', '.join(rows)})"


def best_vehicle(kg: str, volume_cm3: str, km: str) -> Column:
    """Name of the right-sized vehicle type, null when the load is too heavy.

    Order: fits by weight and volume before fits by weight only; then a load
    factor on target by cost per kg, before the rest by highest load factor;
    then payload and file order. Volume beyond the largest hold is taken at
    half, at most one full hold. All types are compared inside one row, so
    choosing a vehicle needs neither a join nor a shuffle. The load is bound
    once, so that its expressions stand in the plan once, whatever they are;
    written out for every type, they made a method that Java does not compile.
    Arguments are SQL expressions.
    """
    hold, target = f"{LARGEST.hold_cm3}D", f"{K.LF_TARGET}D"
    load = (
        f"transform(array({volume_cm3}), c -> named_struct('kg', {kg}, 'km', {km}, "
        f"'cm3', IF(c > {hold}, least(c * 0.5D, {hold}), c)))[0]"
    )
    lf = f"({K.LF_WEIGHT_SHARE}D * least(b.kg / v.kg, 1D) + {K.LF_SPACE_SHARE}D * least(b.cm3 / v.cm3, 1D))"
    per_kg = "IF(b.kg > 0, (v.fix + v.per_km * b.km) / b.kg, double('Infinity'))"
    key = (
        f"transform(array({lf}), lf -> named_struct('fit', IF(b.cm3 <= v.cm3, 0, 1), 'tier', IF(lf >= {target}, 0, 1), "
        f"'key', IF(lf >= {target}, {per_kg}, -lf), 'pos', v.pos, 'name', v.name))[0]"
    )
    best = f"array_min(transform(filter({fleet_literal()}, v -> v.kg >= b.kg), v -> {key})).name"
    return F.expr(f"transform(array({load}), b -> {best})[0]")


def consolidation_type(n, multi_drop) -> Column:
    return (
        F.when(n == 1, F.lit("singleton"))
        .when(multi_drop, F.lit("corridor"))
        .otherwise(F.lit("exact_lane"))
    )


def needs_review(reason, dest_km, detour) -> Column:
    """Whether a pairing reason must be seen by a reviewer."""
    return (
        F.when(reason == "exact_lane", F.lit(False))
        .when(reason.startswith("dest_cluster_"), dest_km > K.REVIEW_DEST_KM_OK)
        .when(reason.startswith("corridor_detour_"), detour > K.REVIEW_DETOUR_OK)
        .otherwise(F.lit(True))
    )


def lf_band(lf) -> Column:
    return F.when(lf >= 0.70, "good").when(lf >= 0.50, "moderate").otherwise("low")


def truck_tags(convoy, axle_ok, n, lf) -> Column:
    return F.array_compact(
        F.array(
            F.when(convoy, F.lit("convoy")),
            F.when(~axle_ok & (n > 1), F.lit("axle warning")),
            F.when(lf < K.LF_FLOOR, F.lit("low util")),
        )
    )


def defer(lf) -> Column:
    return lf < K.DEFER_BELOW_LF


def percent(value, digits: int = 0) -> Column:
    """A ratio as text in per cent, e.g. ``42%``."""
    return F.concat(F.format_string(f"%.{digits}f", rnd(value * F.lit(100.0), digits)), F.lit("%"))


def number(value, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", rnd(value, digits))


def rule_score(n, weight_fraction, bearing_spread, detour, delivery_spread, overlap_h) -> Column:
    score = (
        F.lit(0.5)
        + (weight_fraction - 0.5) * 0.6
        - F.least(F.lit(0.25), bearing_spread / 40.0)
        - F.least(F.lit(0.20), detour * 0.5)
        - F.least(F.lit(0.15), delivery_spread / 600.0)
        + F.least(F.lit(0.10), overlap_h / 12.0)
        + F.when(n >= 2, 0.08).otherwise(0.0)
    )
    heavy_single = (n == 1) & (weight_fraction > 0.80)
    score = F.when(heavy_single, F.greatest(score, F.lit(0.55))).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def feasibility_level(score, n) -> Column:
    return (
        F.when(score >= 0.7, "HIGH")
        .when(score >= 0.5, "MEDIUM")
        .when(n == 1, "LOW (singleton)")
        .otherwise("LOW")
    )


def feasibility_reason(score, n, weight_fraction, bearing_spread, detour, delivery_spread, overlap_h) -> Column:
    """Explanation of a score; a missing part is left out of the list."""
    km = number(delivery_spread, 0)
    parts = [
        F.when(weight_fraction >= 0.75, F.concat(F.lit("high weight fill ("), percent(weight_fraction), F.lit(")")))
        .when(weight_fraction < 0.45, F.concat(F.lit("low weight fill ("), percent(weight_fraction), F.lit(")"))),
        F.when(bearing_spread > 10, F.concat(F.lit("directional spread "), number(bearing_spread, 1), F.lit("° (>10° warning)")))
        .when(bearing_spread < 3, F.concat(F.lit("tight bearing alignment ("), number(bearing_spread, 1), F.lit("°)"))),
        F.when(detour > 0.20, F.concat(F.lit("high detour ("), percent(detour), F.lit(" over direct)")))
        .when(detour > 0.05, F.concat(F.lit("moderate detour ("), percent(detour), F.lit(" over direct)")))
        .when((detour == 0.0) & (n > 1), F.lit("minimal detour"))
        .when(n == 1, F.lit("direct route (single stop)"))
        .otherwise(F.lit("direct route (no multi-drop detour)")),
        F.when(delivery_spread > 150, F.concat(F.lit("wide delivery cluster ("), km, F.lit(" km)")))
        .when(delivery_spread < 30, F.concat(F.lit("tight delivery cluster ("), km, F.lit(" km)"))),
        F.when(overlap_h < 3, F.concat(F.lit("short time overlap ("), number(overlap_h, 1), F.lit("h)"))),
        F.when(n == 1, F.lit("singleton — no consolidation partner")),
    ]
    return F.concat(
        feasibility_level(score, n),
        F.lit(" feasibility ("),
        percent(score),
        F.lit(") — "),
        F.concat_ws(", ", *parts),
    )
