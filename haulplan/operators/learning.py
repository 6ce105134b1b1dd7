"""Zone learning: load-factor averages per grid cell and resolution steps.

A zone's state is folded over its runs in order. The fold is an expression
over the zone's (run, load factor) array, one entry per run, so it stays on
the JVM and its size is bounded by the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import zone_id
from ..functions.rounding import rnd
from .metrics import exact_mean

STATE = (
    "zone_id string, resolution int, run_count int, avg_load_factor double, last_load_factor double, "
    "last_run string, adjustment_log array<struct<run: int, from: int, to: int, reason: string>>"
)
_STRUCT = (
    "struct<resolution: int, run_count: int, avg: double, last: double, last_run: string, "
    "log: array<struct<run: int, from: int, to: int, reason: string>>>"
)


def zone_samples(shipments: DataFrame, run: str = "period", resolution: int = K.DEFAULT_RESOLUTION) -> DataFrame:
    """Mean load factor per zone and run at shipment grain.

    ``shipments``: one row per shipment on a truck with its ``load_factor``.
    Load factors below 0.01 are not yet packed and do not count.
    """
    return (
        shipments.filter(F.col("load_factor") >= K.MIN_ZONE_LF)
        .groupBy(zone_id(F.col("pickup_lat"), F.col("pickup_lng"), resolution).alias("zone_id"), F.col(run).alias("run"))
        .agg(exact_mean("load_factor").alias("sample_lf"), F.count("*").alias("shipments"))
    )


def _text(value: Column) -> Column:
    return F.format_string("%.2f", rnd(value, 2))


def _step(state: Column, sample: Column) -> Column:
    """One run: update the average, then move the resolution by at most one."""
    lf = sample["sample_lf"]
    count = state["run_count"] + 1
    avg = rnd(F.lit(K.EMA_ALPHA) * lf + F.lit(1 - K.EMA_ALPHA) * F.coalesce(state["avg"], lf), 4)
    return F.struct(
        state["resolution"].alias("resolution"), count.alias("run_count"), avg.alias("avg"),
        rnd(lf, 4).alias("last"), sample["run"].alias("last_run"), state["log"].alias("log"),
    )


def _adjust(s: Column) -> Column:
    res = s["resolution"]
    ready = s["run_count"] >= K.MIN_RUNS_TO_ADJUST
    low = ready & (s["avg"] < K.LOW_LF) & (res > K.MIN_RESOLUTION)
    high = ready & (s["avg"] > K.HIGH_LF) & (res < K.MAX_RESOLUTION)
    new = F.when(low, res - 1).when(high, res + 1).otherwise(res)
    reason = F.when(low, F.concat(F.lit("low_load_factor (avg="), _text(s["avg"]), F.lit(f" < {K.LOW_LF})"))).otherwise(
        F.concat(F.lit("high_load_factor (avg="), _text(s["avg"]), F.lit(f" > {K.HIGH_LF})"))
    )
    entry = F.array(F.struct(s["run_count"].alias("run"), res.alias("from"), new.alias("to"), reason.alias("reason")))
    return F.struct(
        new.alias("resolution"), s["run_count"].alias("run_count"), s["avg"].alias("avg"), s["last"].alias("last"),
        s["last_run"].alias("last_run"), F.when(low | high, F.concat(s["log"], entry)).otherwise(s["log"]).alias("log"),
    )


def fold_runs(samples: DataFrame, state: DataFrame | None = None, resolution: int = K.DEFAULT_RESOLUTION) -> DataFrame:
    """Zone state after the given runs, starting from ``state``.

    A zone that is new starts its average at its first sample. Zones without a
    sample keep their state.
    """
    runs = samples.groupBy("zone_id").agg(
        F.sort_array(F.collect_list(F.struct("run", "sample_lf"))).alias("runs")
    )
    empty_log = "CAST(array() AS array<struct<run: int, from: int, to: int, reason: string>>)"
    if state is None:
        df = runs.select("zone_id", "runs", *[F.lit(None).alias(c) for c in ("resolution", "run_count", "avg_load_factor", "last_load_factor", "last_run", "adjustment_log")])
    else:
        df = state.join(runs, "zone_id", "full_outer")
    start = F.struct(
        F.coalesce(F.col("resolution").cast("int"), F.lit(resolution)).alias("resolution"),
        F.coalesce(F.col("run_count").cast("int"), F.lit(0)).alias("run_count"),
        F.col("avg_load_factor").cast("double").alias("avg"),
        F.col("last_load_factor").cast("double").alias("last"),
        F.col("last_run").cast("string").alias("last_run"),
        F.coalesce(F.col("adjustment_log").cast("array<struct<run: int, from: int, to: int, reason: string>>"), F.expr(empty_log)).alias("log"),
    ).cast(_STRUCT)
    runs_in = F.coalesce("runs", F.expr("CAST(array() AS array<struct<run: string, sample_lf: double>>)"))
    out = F.aggregate(runs_in, start, lambda s, x: _adjust(_step(s, x)).cast(_STRUCT))
    return df.withColumn("s", out).select(
        "zone_id", F.col("s.resolution").alias("resolution"), F.col("s.run_count").alias("run_count"),
        F.col("s.avg").alias("avg_load_factor"), F.col("s.last").alias("last_load_factor"),
        F.col("s.last_run").alias("last_run"), F.col("s.log").alias("adjustment_log"),
    )


def record_run(shipments: DataFrame, state: DataFrame | None = None, run: str = "period", resolution: int = K.DEFAULT_RESOLUTION) -> DataFrame:
    """Sample the trucks of one or more runs and fold them into the state."""
    return fold_runs(zone_samples(shipments, run, resolution), state, resolution)


def reset_zones(state: DataFrame, zone: str | None = None) -> DataFrame:
    """Clear the statistics of one zone or of all; the resolution stays."""
    hit = F.lit(True) if zone is None else F.col("zone_id") == zone
    types = dict(state.dtypes)
    blank = {"run_count": 0, "avg_load_factor": 0.0, "last_load_factor": 0.0, "last_run": None}
    out = state.withColumns({c: F.when(hit, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in blank.items()})
    return out.withColumn("adjustment_log", F.when(hit, F.slice("adjustment_log", 1, 0)).otherwise(F.col("adjustment_log")))


def zone_summary(state: DataFrame) -> DataFrame:
    seen = F.col("avg_load_factor") > K.MIN_ZONE_LF
    return state.withColumn("_seen", F.when(seen, F.col("avg_load_factor"))).agg(
        F.count("*").alias("zones_tracked"),
        F.coalesce(F.sum("run_count"), F.lit(0)).alias("total_observations"),
        F.count_if(F.size("adjustment_log") > 0).alias("zones_auto_adjusted"),
        F.coalesce(rnd(exact_mean("_seen", 10_000), 3), F.lit(0.0)).alias("global_avg_load_factor"),
    ).withColumn("learning_active", F.col("zones_auto_adjusted") > 0)


def resolution_histogram(state: DataFrame) -> DataFrame:
    return state.groupBy("resolution").agg(F.count("*").alias("zones"))


def improved_zones(state: DataFrame) -> DataFrame:
    return state.filter((F.size("adjustment_log") > 0) & (F.col("avg_load_factor") > K.LOW_LF)).select(
        "zone_id", F.size("adjustment_log").alias("adjustments_made"),
        F.col("avg_load_factor").alias("current_lf"), F.col("resolution").alias("current_res"),
    )


def zone_history(state: DataFrame, zone: str) -> DataFrame:
    return state.filter(F.col("zone_id") == zone)


def zone_resolutions(shipments: DataFrame, state: DataFrame, default: int = K.DEFAULT_RESOLUTION) -> DataFrame:
    """Learned resolution of every zone the shipments start in; unseen zones get the default."""
    zones = shipments.select(zone_id(F.col("pickup_lat"), F.col("pickup_lng"), default).alias("zone_id")).distinct()
    return zones.join(state.select("zone_id", F.col("resolution").alias("learned")), "zone_id", "left").select(
        "zone_id", F.coalesce("learned", F.lit(default)).alias("resolution"), F.col("learned").isNotNull().alias("known")
    )
