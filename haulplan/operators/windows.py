"""Delivery-window grouping.

Joining shipments in order of earliest time to the open group while their
common window stays long enough never leaves two groups open at once: a new
group starts only when no open group can take the shipment, and a group that
refused one shipment refuses every later one. With ``right = latest - minimum
overlap`` this is interval stabbing. The first group ends at the smallest
``right`` of all, the next at the smallest ``right`` among windows that start
later, and so on; a shipment's group follows from its start time alone.

So only one row per distinct start time is needed to place the group borders.
That table is bounded by the clock, whatever the number of shipments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread


def add_islands(df: DataFrame, keys: list[str], start, right, order: list) -> DataFrame:
    """Number runs of windows so that no group can span two of them.

    A new island opens when a window starts after everything before it has
    ended. ``df`` must be small per key (distinct start times or singletons).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col(start) > F.max(right).over(before), 1).otherwise(0)
    return (
        df.withColumn("_opens", opens)
        .withColumn("island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .drop("_opens")
    )


def stab_groups(start, right) -> np.ndarray:
    """Group number of each sorted distinct start time."""
    start, right = np.asarray(start), np.asarray(right)
    ends = np.minimum.accumulate(right[::-1])[::-1]
    out = np.empty(len(start), dtype=np.int32)
    i, k = 0, 0
    while i < len(start):
        j = int(np.searchsorted(start, ends[i], side="right"))
        out[i:j] = k
        i, k = j, k + 1
    return out


_GROUPS = (
    T.StructType()
    .add("k", T.ArrayType(T.IntegerType()))
    .add("n", T.ArrayType(T.LongType()))
    .add("u", T.ArrayType(T.LongType()))
)


@F.pandas_udf(_GROUPS)
def _stab_udf(start: pd.Series, right: pd.Series, n: pd.Series, u: pd.Series) -> pd.DataFrame:
    out = {"k": [], "n": [], "u": []}
    for s, r, cnt, units in zip(start, right, n, u):
        k = stab_groups(s, r)
        out["k"].append(k)
        for name, v in (("n", cnt), ("u", units)):
            total = np.zeros(k[-1] + 1, dtype=np.int64)
            np.add.at(total, k, v)
            out[name].append(total[k])
    return pd.DataFrame(out)


def window_groups(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Border table of the window groups.

    ``windows`` holds the keys, ``earliest_s``, ``latest_s``, ``min_overlap_s``,
    ``n`` and ``u`` (shipments and weight units of that window). Windows
    shorter than the minimum take no part. Result: (keys, earliest_s) ->
    window_no, group_n, group_u.
    """
    right = F.col("latest_s") - F.col("min_overlap_s")
    starts = (
        windows.filter(right >= F.col("earliest_s"))
        .groupBy(*keys, "earliest_s")
        .agg(F.min(right).alias("right"), F.max(right).alias("reach"), F.sum("n").alias("n"), F.sum("u").alias("u"))
    )
    rows = F.sort_array(F.collect_list(F.struct("earliest_s", "right", "n", "u")))
    packed = (
        add_islands(spread(starts, *keys), keys, "earliest_s", "reach", ["earliest_s"])
        .groupBy(*keys, "island")
        .agg(rows.alias("r"))
        .withColumn("g", _stab_udf("r.earliest_s", "r.right", "r.n", "r.u"))
    )
    z = F.arrays_zip(
        F.col("r.earliest_s").alias("earliest_s"), F.col("g.k").alias("k"),
        F.col("g.n").alias("n"), F.col("g.u").alias("u"),
    )
    return packed.select(*keys, "island", F.explode_outer(z).alias("z")).select(
        *keys, "z.earliest_s",
        F.struct("island", F.col("z.k").alias("k")).alias("window_no"),
        F.col("z.n").alias("group_n"), F.col("z.u").alias("group_u"),
    )
