"""Corridor pairing of the shipments left alone by the window grouping.

The candidates of one origin cluster and period are few by construction: at
most one lone shipment per destination cluster and window group, so their
number is bounded by places and clock time, not by shipments. They are cut
into time islands before pairing, and pairs are tested row by row inside the
helper; none are emitted but the chosen ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.geo import detour_offset, haversine_km
from ..functions import geo_np
from ..functions.measures import needs_review, number, percent
from ..functions.rounding import rnd
from ..plans.params import scenario_value
from ..session import spread
from .windows import add_islands


def pair_reason(dest_km, detour, same_place, dest_limit, detour_limit):
    """Why two shipments may share a route; null when they may not."""
    km = number(dest_km, 0)
    return (
        F.when(same_place, F.lit("exact_lane"))
        .when(rnd(dest_km, 6) <= dest_limit, F.concat(F.lit("dest_cluster_"), km, F.lit("km")))
        .when(rnd(detour, 6) <= detour_limit, F.concat(F.lit("corridor_detour_"), percent(detour)))
    )


def route_compatibility(pairs: DataFrame, dest_limit=50.0, detour_limit=0.20) -> DataFrame:
    """Verdict for given pairs with columns a_* and b_* (plat, plng, dlat, dlng, place)."""
    a, b = ({c: F.col(f"{s}_{c}") for c in ("plat", "plng", "dlat", "dlng")} for s in "ab")
    return (
        pairs.withColumns(
            {
                "dest_km": haversine_km(a["dlat"], a["dlng"], b["dlat"], b["dlng"]),
                "detour": detour_offset(a, b),
            }
        )
        .withColumn(
            "reason",
            pair_reason(F.col("dest_km"), F.col("detour"), F.col("a_place") == F.col("b_place"), dest_limit, detour_limit),
        )
        .withColumns(
            {
                "compatible": F.col("reason").isNotNull(),
                "needs_review": needs_review(F.col("reason"), F.col("dest_km"), F.col("detour")),
            }
        )
    )


def candidate_pairs(singles: DataFrame, keys: list[str], min_overlap: int = 30, bucket: int = 60) -> DataFrame:
    """Pairs (a_*, b_*) of lone shipments of one key that may share a truck by weight and time, a's place first by name.

    ``singles``: id, plat, plng, dlat, dlng, place, kg, e, t (window in minutes).
    A single stands in every ``bucket`` of the clock in which a common window of at
    least ``min_overlap`` may begin, so a hub's shipments meet only those of their
    hours; a pair is made in one bucket alone, that of the later start.
    """
    fields = [c for c in singles.columns if c not in keys]
    hours = F.sequence(F.floor(F.col("e") / bucket), F.floor((F.col("t") - min_overlap) / bucket))
    wide = singles.filter(F.col("t") - F.col("e") >= min_overlap).withColumn("hour", F.explode(hours))
    side = lambda p: wide.select(*keys, "hour", *[F.col(c).alias(f"{p}_{c}") for c in fields])
    overlap = F.least("a_t", "b_t") - F.greatest("a_e", "b_e")
    return (
        side("a").join(side("b"), [*keys, "hour"])
        .filter((F.col("a_place") < F.col("b_place")) & (F.col("a_kg") + F.col("b_kg") <= K.MAX_PAYLOAD_U / K.WEIGHT_UNITS_PER_KG))
        .filter((overlap >= min_overlap) & (F.floor(F.greatest("a_e", "b_e") / bucket) == F.col("hour")))
        .withColumn("overlap_min", overlap).drop("hour")
    )


def pair_up(ids, units, start, end, plat, plng, dlat, dlng, place, refused, overlap, dest_limit, detour_limit):
    """First-come pairing in list order; each shipment joins at most one pair.

    A pair needs room under the payload cap, a common window and a compatible
    route. Pairs that need a review and were refused are passed over.
    """
    units, start, end = (np.asarray(v) for v in (units, start, end))
    plat, plng, dlat, dlng = (np.asarray(v) for v in (plat, plng, dlat, dlng))
    place = np.asarray(place, dtype=object)
    free = np.ones(len(ids), dtype=bool)
    out = []
    for i in range(len(ids) - 1):
        if not free[i]:
            continue
        j = np.arange(i + 1, len(ids))
        ok = free[j] & (units[i] + units[j] <= K.MAX_PAYLOAD_U)
        ok &= np.minimum(end[i], end[j]) - np.maximum(start[i], start[j]) >= overlap
        j = j[ok]
        if not len(j):
            continue
        same = place[j] == place[i]
        km = geo_np.haversine_km(dlat[i], dlng[i], dlat[j], dlng[j])
        near = np.round(km, 6) <= dest_limit
        detour = geo_np.detour_offset((plat[i], plng[i]), (dlat[i], dlng[i]), (plat[j], plng[j]), (dlat[j], dlng[j]))
        bend = np.round(detour, 6) <= detour_limit
        review = ~same & np.where(near, km > K.REVIEW_DEST_KM_OK, detour > K.REVIEW_DETOUR_OK)
        no = set() if refused[i] is None else set(refused[i])
        for x in np.flatnonzero(same | near | bend):
            if review[x] and ids[j[x]] in no:
                continue
            free[i] = free[j[x]] = False
            out.append((i, int(j[x]), bool(same[x]), bool(near[x]), float(km[x]), float(detour[x]), bool(review[x])))
            break
    return out


_PAIR = {
    "i": T.IntegerType(), "j": T.IntegerType(), "same": T.BooleanType(), "near": T.BooleanType(),
    "km": T.DoubleType(), "detour": T.DoubleType(), "reviewed": T.BooleanType(),
}
_FIELDS = ("shipment_id", "u", "start", "end", "plat", "plng", "dlat", "dlng", "place", "refused")


@F.pandas_udf(T.StructType([T.StructField(f, T.ArrayType(t)) for f, t in _PAIR.items()]))
def _pair_udf(
    ids: pd.Series, u: pd.Series, start: pd.Series, end: pd.Series, plat: pd.Series, plng: pd.Series,
    dlat: pd.Series, dlng: pd.Series, place: pd.Series, refused: pd.Series,
    overlap: pd.Series, dest_limit: pd.Series, detour_limit: pd.Series,
) -> pd.DataFrame:
    cols = (ids, u, start, end, plat, plng, dlat, dlng, place, refused, overlap, dest_limit, detour_limit)
    pairs = [pair_up(*row) for row in zip(*cols)]
    return pd.DataFrame({f: [[p[i] for p in ps] for ps in pairs] for i, f in enumerate(_PAIR)})


def refused_partners(decisions: DataFrame) -> DataFrame:
    """Review decisions (id_a, id_b, approved) -> refused partners per shipment.

    Missing decisions count as approved.
    """
    no = decisions.filter(~F.coalesce("approved", F.lit(True)))
    both = no.select(F.col("id_a").alias("shipment_id"), F.col("id_b").alias("other")).union(
        no.select(F.col("id_b"), F.col("id_a"))
    )
    return both.groupBy("shipment_id").agg(F.collect_set("other").alias("refused"))


def corridor_pairs(singles: DataFrame, scenarios, decisions: DataFrame | None = None) -> DataFrame:
    """Pairs of lone shipments: two rows per pair, unit_id -> group_id.

    ``singles``: scenario_id, period, origin_cluster, dest_cluster, window_no,
    unit_id and the single's fields.
    """
    keys = ["scenario_id", "period", "origin_cluster"]
    if decisions is None:
        singles = singles.withColumn("refused", F.lit(None).cast("array<string>"))
    else:
        singles = singles.join(refused_partners(decisions), "shipment_id", "left")
    singles = singles.withColumn("right", F.col("end") - scenario_value("min_overlap_s", scenarios))
    cut = add_islands(spread(singles, *keys), keys, "start", "right", ["start", "shipment_id"])
    rows = F.sort_array(F.collect_list(F.struct("dest_cluster", "window_no", "unit_id", *_FIELDS)))
    packed = (
        cut.groupBy(*keys, "island")
        .agg(rows.alias("r"))
        .filter(F.size("r") > 1)
        .withColumn(
            "p",
            _pair_udf(
                *[F.col(f"r.{f}") for f in _FIELDS],
                scenario_value("min_overlap_s", scenarios),
                scenario_value("delivery_cluster_km", scenarios),
                scenario_value("clustering_detour", scenarios),
            ),
        )
        .withColumn("p", F.explode(F.arrays_zip(*[F.col(f"p.{f}").alias(f) for f in _PAIR])))
    )
    first = F.element_at("r.unit_id", F.col("p.i") + 1)
    second = F.element_at("r.unit_id", F.col("p.j") + 1)
    reason = (
        F.when(F.col("p.same"), F.lit("exact_lane"))
        .when(F.col("p.near"), F.concat(F.lit("dest_cluster_"), number(F.col("p.km"), 0), F.lit("km")))
        .otherwise(F.concat(F.lit("corridor_detour_"), percent(F.col("p.detour"))))
    )
    return packed.select(
        F.explode(F.array(first, second)).alias("unit_id"),
        F.concat(first, F.lit("+c")).alias("group_id"),
        F.lit(True).alias("multi_drop"),
        reason.alias("corridor_reason"),
        F.col("p.reviewed").alias("hitl_reviewed"),
    )
