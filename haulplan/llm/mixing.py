"""Mixing to target marginals by iterative proportional fitting, with built-in functions only.

Weights live on the cells of the dimensions (hub, goods type, wave), which are
summed on the map side, so a hub with a third of all rows is a few cells. A
round scales the cells to each dimension's target shares in turn. Rows are then
sampled with the calibrated probability of their cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stages

DIMENSIONS = ("pickup_hub", "goods_type", "wave")
#: Rounds planned between two looks at the error.
ROUNDS = 3
NONE = "(none)"
_PROBES = 32


def _named(dimensions: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in dimensions]


def tempered_targets(shipments: DataFrame, dimensions: Sequence[str] = DIMENSIONS, power: float = 0.7) -> DataFrame:
    """Targets (dimension, value, share): each value's share of the tokens, raised to ``power`` and rescaled.

    A power below one lifts small values. Null values are the value ``(none)``.
    """
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in zip(dimensions, _named(dimensions))])
    mass = shipments.select(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.inline(rows)).groupBy("dimension", "value")
    raised = mass.agg(F.sum("n_tokens").alias("n")).filter("n > 0").withColumn("share", F.pow(F.col("n").cast("double"), F.lit(power)))
    total = F.sum("share").over(Window.partitionBy("dimension"))
    return raised.select("dimension", "value", (F.col("share") / total).alias("share"))


def rake(cells: DataFrame, targets: DataFrame, dimensions: Sequence[str] = DIMENSIONS, tolerance: float = 1e-4, most_rounds: int = 30) -> DataFrame:
    """``cells`` (dimensions, n_tokens) with ``weight``: token shares that meet the target marginals.

    Rounds stop when no marginal is off by more than ``tolerance`` or after
    ``most_rounds``. A value without a target gets weight zero; a target
    without cells is left out and the others stand for their sum.
    """
    run = stages(cells.sparkSession, "mixing")
    for d in dimensions:
        own = targets.filter(F.col("dimension") == d).select(F.col("value").alias(d), F.col("share").alias(f"_{d}"))
        cells = cells.join(own, d, "left").fillna({f"_{d}": 0.0})
    possible = F.lit(True)
    for d in dimensions:
        possible = possible & (F.col(f"_{d}") > 0)
    cells = cells.withColumn("weight", F.when(possible & (F.col("n_tokens") > 0), F.col("n_tokens").cast("double")).otherwise(0.0))
    cells = run.save(cells, "cells")
    for d in dimensions:  # shares over the values that can be met
        met = cells.filter("weight > 0").select(d, f"_{d}").distinct().agg(F.sum(f"_{d}")).first()[0]
        cells = cells.withColumn(f"_{d}", F.col(f"_{d}") / F.lit(met or 1.0))
    done = 0
    while done < most_rounds:
        for _ in range(ROUNDS):
            for d in dimensions:
                held = F.sum("weight").over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"_{d}") / held).otherwise(0.0))
        done += ROUNDS
        cells = run.save(cells, f"round{done}")
        if marginal_error(cells, dimensions) <= tolerance:
            break
    return cells.select(*dimensions, "n_tokens", "weight")


def marginal_error(cells: DataFrame, dimensions: Sequence[str]) -> float:
    """The largest gap between a marginal of the weights and its target."""
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"_{d}").alias("share")) for d in dimensions])
    held = cells.filter("weight > 0").select("weight", F.inline(rows)).groupBy("dimension", "value").agg(F.sum("weight").alias("w"), F.first("share").alias("s"))
    return float(held.agg(F.max(F.abs(F.col("w") - F.col("s")))).first()[0] or 0.0)


def calibrated(cells: DataFrame, keep: float | None, least_keep: float = 0.0) -> DataFrame:
    """``cells`` with ``probability``: weight per token, scaled.

    Without ``keep`` the largest probability is one, so the expected mix meets
    the targets exactly, unless that keeps less than ``least_keep`` of the
    tokens. With it, or then, that share of all tokens is expected and
    probabilities end at one, which bends the mix where they do: cells that
    run out stay whole, all others keep their proportions. The scale is
    found by aggregations over a ladder of scales.
    """
    lift = F.when(F.col("n_tokens") > 0, F.col("weight") / F.col("n_tokens")).otherwise(0.0)
    total, top = cells.agg(F.sum("n_tokens"), F.max(lift)).first()
    if not total or not top:
        return cells.withColumn("probability", F.lit(0.0))
    low, high = 0.0, 1.0 / top
    if keep is None and _expected(cells, lift, [high])[0] < least_keep * total:
        keep = least_keep
    if keep is None:
        return cells.withColumn("probability", F.least(F.lit(1.0), lift * high))
    while high < 1e18 / top and _expected(cells, lift, [high])[0] < keep * total:
        low, high = high, high * 16
    for _ in range(3):
        ladder = [low + (high - low) * i / _PROBES for i in range(1, _PROBES + 1)]
        met = _expected(cells, lift, ladder)
        first = next((i for i, x in enumerate(met) if x >= keep * total), _PROBES - 1)
        low, high = (ladder[first - 1] if first else low), ladder[first]
    return cells.withColumn("probability", F.least(F.lit(1.0), lift * high))


def _expected(cells: DataFrame, lift: Column, scales: list[float]) -> list[float]:
    sums = [F.sum(F.least(F.lit(1.0), lift * s) * F.col("n_tokens")).alias(f"s{i}") for i, s in enumerate(scales)]
    return [float(x or 0) for x in cells.agg(*sums).first()]


def with_gap(cells: DataFrame, targets: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``cells`` with ``gap``: of the cell's values, the largest distance between expected share of the mix and target.

    It tells which targets are missed, because probabilities end at one, rounds
    ended early or a value has no tokens. A value without a target has target zero.
    """
    expected = F.col("probability") * F.col("n_tokens")
    total = cells.agg(F.sum(expected)).first()[0]
    gaps = []
    for d in dimensions:
        own = targets.filter(F.col("dimension") == d).select(F.col("value").alias(d), F.col("share").alias(f"_{d}"))
        held = F.sum(expected).over(Window.partitionBy(d)) / F.lit(float(total or 1.0))
        cells = cells.join(own, d, "left").withColumn(f"_{d}", F.abs(held - F.coalesce(f"_{d}", F.lit(0.0))))
        gaps.append(F.col(f"_{d}"))
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return cells.withColumn("gap", gap).drop(*[f"_{d}" for d in dimensions])


def mix_shipments(
    shipments: DataFrame, targets: DataFrame | None = None, dimensions: Sequence[str] = DIMENSIONS,
    keep: float | None = None, power: float = 0.7, seed: int = 1, least_keep: float = 0.0, gaps: bool = False,
) -> DataFrame:
    """Rake token weights to target marginals and sample rows by calibrated probability.

    ``shipments`` have ``n_tokens`` and the dimensions; ``targets`` (dimension,
    value, share) default to ``tempered_targets`` with ``power``. ``keep`` is the expected
    share of the tokens that stay; without it, as many as the targets allow,
    but no less than ``least_keep``: a value with next to no tokens must not
    thin all others (see ``calibrated``). The draw is a hash of id and ``seed``, so it
    is the same on every run, and rows that share an id draw alike.

    Returns one row per input row: ``shipment_id``, the dimensions (null as
    ``(none)``), ``n_tokens`` (null as 0), ``weight`` (the cell's share of the
    mix), ``probability``, ``selected`` and, with ``gaps``, ``gap`` (see ``with_gap``). Rows in cells without tokens or
    targets get probability zero. An empty table gives no rows.
    """
    run = stages(shipments.sparkSession, "mixing-rows")
    rows = run.save(
        shipments.select("shipment_id", *_named(dimensions), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), "rows"
    )
    targets = tempered_targets(rows, dimensions, power) if targets is None else targets
    cells = rows.groupBy(*dimensions).agg(F.sum("n_tokens").alias("n_tokens"))
    cells = calibrated(rake(cells, targets, dimensions), keep, least_keep)
    if gaps:
        cells = with_gap(cells, targets, dimensions)
    more = ["gap"] if gaps else []
    cells = cells.select(*dimensions, "weight", "probability", *more)
    draw = F.pmod(F.xxhash64("shipment_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return rows.join(cells, list(dimensions), "left").select(
        "shipment_id", *dimensions, "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("selected"), *more
    )
