"""Second pass: same-lane shipments still alone share a truck where they fit.

The rule is next-fit over a lane's lone shipments in order of window group and
weight. Within one window group any two of them are together over the payload cap (first-fit
would have joined them), so all but the first and the last close alone. Only
those two per lane and window group can share, which bounds a lane's list by
the clock; both come from map-side aggregates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..plans.params import scenario_value
from ..session import spread


def next_fit(units, start, end, overlap: int) -> list[int]:
    """Bin number per entry: a bin closes when weight or window does not fit."""
    out, b, load, lo, hi = [], -1, None, 0, 0
    for u, s, e in zip(units, start, end):
        if load is not None and load + u <= K.MAX_PAYLOAD_U and min(hi, e) - max(lo, s) >= overlap:
            load, lo, hi = load + u, max(lo, s), min(hi, e)
        else:
            b, load, lo, hi = b + 1, u, s, e
        out.append(b)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _next_fit_udf(u: pd.Series, start: pd.Series, end: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([next_fit(*row) for row in zip(u, start, end, overlap)])


def same_lane_regroup(singles: DataFrame, scenarios) -> DataFrame:
    """unit_id -> group_id for lone shipments that now share a truck."""
    lane = ["scenario_id", "period", "pickup_place", "delivery_place"]
    entry = F.struct("u", "start", "end", "unit_id")
    order = F.struct((-F.col("u")).alias("neg"), "start", "shipment_id")
    ends = singles.groupBy(*lane, "window_no").agg(
        F.min_by(entry, order).alias("head"), F.max_by(entry, order).alias("tail")
    )
    pair = F.array_distinct(F.array("head", "tail"))
    rows = F.sort_array(F.collect_list(F.struct("window_no", pair.alias("e"))))
    lists = (
        spread(ends, *lane)
        .groupBy(*lane)
        .agg(rows.alias("r"))
        .withColumn("e", F.flatten("r.e"))
        .filter(F.size("e") > 1)
        .withColumn("b", _next_fit_udf("e.u", "e.start", "e.end", scenario_value("min_overlap_s", scenarios)))
    )
    z = F.explode_outer(F.arrays_zip(F.col("e.unit_id").alias("unit_id"), F.col("b").alias("b")))
    flat = lists.select(*lane, z.alias("z")).select(*lane, "z.*")
    bins = flat.groupBy(*lane, "b").agg(F.collect_list("unit_id").alias("ids")).filter(F.size("ids") > 1)
    return bins.select(
        F.explode("ids").alias("unit_id"),
        F.concat(F.array_min("ids"), F.lit("+r")).alias("group_id"),
        F.lit(False).alias("multi_drop"),
        F.lit(None).cast("string").alias("corridor_reason"),
        F.lit(False).alias("hitl_reviewed"),
    )
