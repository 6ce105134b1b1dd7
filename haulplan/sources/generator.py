"""Synthetic shipments: weighted hubs and lanes, weight tiers, boxes, dispatch waves.

Every draw is a hash of (seed, row id, field), so a row is the same whatever
the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import rnd

# Hub -> (lat, lng, share, wave weights morning/afternoon/evening).
HUBS = {
    "Bhiwandi Logistics Park": (19.296, 73.066, 22, (0.65, 0.30, 0.05)),
    "Taloja MIDC": (18.903, 73.111, 16, (0.60, 0.35, 0.05)),
    "Chakan Auto Cluster": (18.658, 73.773, 16, (0.55, 0.40, 0.05)),
    "Pimpri-Chinchwad MIDC": (18.534, 73.854, 14, (0.55, 0.40, 0.05)),
    "Thane Industrial Estate": (19.218, 72.978, 10, (0.50, 0.45, 0.05)),
    "Nashik MIDC": (20.011, 73.765, 6, (0.55, 0.40, 0.05)),
    "Surat Textile Hub": (21.170, 72.831, 6, (0.35, 0.55, 0.10)),
    "Vadodara GIDC": (22.307, 73.181, 5, (0.40, 0.50, 0.10)),
    "Ahmedabad Naroda GIDC": (22.980, 72.499, 5, (0.60, 0.35, 0.05)),
    "Bangalore Peenya": (12.971, 77.594, 2, (0.50, 0.40, 0.10)),
}
# Destination -> (lat, lng).
DROPS = {
    "Pune Distribution Centre": (18.520, 73.856),
    "Surat Wholesale Market": (21.195, 72.830),
    "Ahmedabad CFS": (23.022, 72.571),
    "Nagpur Butibori": (21.146, 79.088),
    "Hyderabad": (17.385, 78.487),
    "Chennai": (13.067, 80.237),
    "Mumbai BKC Warehouse": (19.076, 72.877),
    "Kanpur": (26.449, 80.331),
    "Delhi NCR Mundka": (28.613, 77.209),
    "Kolkata Dankuni": (22.794, 88.328),
    "Hubli": (15.317, 75.135),
    "Kolhapur": (16.704, 74.243),
}
# Hub -> its main lanes with weights (80 % of its shipments).
LANES = {
    "Bhiwandi Logistics Park": {"Pune Distribution Centre": 18, "Surat Wholesale Market": 10, "Ahmedabad CFS": 8, "Nagpur Butibori": 6},
    "Taloja MIDC": {"Pune Distribution Centre": 12, "Surat Wholesale Market": 8, "Hyderabad": 6},
    "Chakan Auto Cluster": {"Surat Wholesale Market": 10, "Ahmedabad CFS": 8, "Hyderabad": 6, "Chennai": 4},
    "Pimpri-Chinchwad MIDC": {"Surat Wholesale Market": 8, "Ahmedabad CFS": 8, "Hyderabad": 5},
    "Nashik MIDC": {"Pune Distribution Centre": 6, "Mumbai BKC Warehouse": 5},
    "Surat Textile Hub": {"Mumbai BKC Warehouse": 8, "Kanpur": 4},
    "Vadodara GIDC": {"Mumbai BKC Warehouse": 5, "Pune Distribution Centre": 4},
    "Ahmedabad Naroda GIDC": {"Mumbai BKC Warehouse": 6, "Delhi NCR Mundka": 4},
    "Thane Industrial Estate": {"Pune Distribution Centre": 6, "Surat Wholesale Market": 4},
    "Bangalore Peenya": {"Chennai": 4, "Hyderabad": 3},
}
MAIN_LANE_SHARE = 0.80
# Destinations of the remaining shipments, equally likely.
OTHER_DROPS = ("Delhi NCR Mundka", "Kolkata Dankuni", "Chennai", "Kanpur", "Hubli", "Kolhapur")
# Goods -> (share, weight tier, box ranges l, w, h in cm).
GOODS = {
    "automotive_parts": (20, "heavy", (100, 500), (80, 210), (60, 190)),
    "fmcg_packaged_goods": (18, "medium", (80, 350), (60, 200), (60, 180)),
    "construction_material": (15, "heavy", (150, 600), (80, 210), (60, 200)),
    "textiles_apparel": (12, "medium", (100, 400), (80, 210), (60, 200)),
    "chemicals_industrial": (10, "heavy", (80, 350), (80, 200), (80, 180)),
    "pharma_medical": (8, "light", (60, 200), (50, 150), (40, 120)),
    "electronics": (8, "light", (60, 300), (50, 180), (40, 150)),
    "steel_metal_parts": (9, "heavy", (120, 500), (80, 210), (60, 180)),
}
# Tier -> (cumulative share, kg from, kg to).
TIERS = {
    "light": ((0.60, 300, 3000), (0.90, 3000, 7000), (1.0, 7000, 12000)),
    "medium": ((0.45, 800, 4500), (0.80, 4500, 10000), (1.0, 10000, 18000)),
    "heavy": ((0.30, 1500, 5000), (0.65, 5000, 12000), (1.0, 12000, 22000)),
}
# Waves as minutes of the day.
WAVES = ((360, 660), (720, 1020), (1020, 1260))
HUB_SPREAD_DEG, DROP_SPREAD_DEG = 0.06, 0.07
MIN_KG_PER_M3, SHRINK_CM, MIN_SIDE_CM = 100, 5, 30
DAY = "2024-01-15"


def _draw(seed: int, field: str) -> Column:
    """Uniform in [0, 1) from the row id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(field), F.col("id")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(draw: str, options: dict) -> str:
    """SQL CASE choosing a key by weight."""
    total, acc, cases = float(sum(options.values())), 0.0, []
    for name, weight in options.items():
        acc += weight
        cases.append(f"WHEN {draw} < {acc / total}D THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{name}' END"


def _whole(draw: str, lo, hi) -> str:
    return f"CAST({lo} + floor({draw} * ({hi} - {lo} + 1)) AS INT)"


def _by(key: str, table: dict, value) -> str:
    return f"CASE {key} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {value(v)}' for k, v in table.items())} END"


FIELDS = ("hub", "plat", "plng", "lane", "drop", "dlat", "dlng", "goods", "roll", "kg", "l", "w", "h", "wave", "start", "length")


def generate_shipments(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` shipments in the CSV layout."""
    df = spark.range(n).withColumns({f"u_{f}": _draw(seed, f) for f in FIELDS})
    df = df.withColumns(
        {
            "pickup_hub": F.expr(_pick("u_hub", {k: v[2] for k, v in HUBS.items()})),
            "goods_type": F.expr(_pick("u_goods", {k: v[0] for k, v in GOODS.items()})),
        }
    )
    other = _pick("u_drop", {d: 1 for d in OTHER_DROPS})
    tier = _by("goods_type", GOODS, lambda v: f"'{v[1]}'")

    def weight(parts) -> str:
        cases = " ".join(f"WHEN u_roll < {share}D THEN {lo} + u_kg * {hi - lo}" for share, lo, hi in parts)
        return f"CASE {cases} END"

    def wave(weights) -> str:
        return f"CASE WHEN u_wave < {weights[0]}D THEN 0 WHEN u_wave < {weights[0] + weights[1]}D THEN 1 ELSE 2 END"

    df = df.withColumns(
        {
            "delivery_hub": F.expr(
                f"IF(u_lane < {MAIN_LANE_SHARE}D, {_by('pickup_hub', LANES, lambda v: _pick('u_drop', v))}, {other})"
            ),
            "weight_kg": rnd(F.expr(_by(tier, TIERS, weight)).cast("double"), 1),
            "wave": F.expr(_by("pickup_hub", HUBS, lambda v: wave(v[3]))),
            **{
                side: F.expr(_by("goods_type", GOODS, lambda v, k=k, u=u: _whole(u, *v[k])))
                for side, k, u in (("l", 2, "u_l"), ("w", 3, "u_w"), ("h", 4, "u_h"))
            },
        }
    )
    # light boxes lose 5 cm on their longest side until they are dense enough
    longest = "CASE WHEN b.l >= b.w AND b.l >= b.h THEN 'l' WHEN b.w >= b.h THEN 'w' ELSE 'h' END"
    cut = lambda s: f"IF({longest} = '{s}', greatest({MIN_SIDE_CM}, b.{s} - {SHRINK_CM}), b.{s})"
    thin = f"weight_kg * 1000000D < {MIN_KG_PER_M3}D * b.l * b.w * b.h"
    smaller = f"named_struct('l', {cut('l')}, 'w', {cut('w')}, 'h', {cut('h')})"
    steps = sum(max(v[k][1] for v in GOODS.values()) for k in (2, 3, 4)) // SHRINK_CM
    box = f"aggregate(sequence(1, {steps}), named_struct('l', l, 'w', w, 'h', h), (b, i) -> IF({thin}, {smaller}, b))"
    start = _by("wave", dict(enumerate(WAVES)), lambda v: f"{v[0]} + {_whole('u_start', 0, int((v[1] - v[0]) * 0.6))}").replace("'", "")
    close = _by("wave", dict(enumerate(WAVES)), lambda v: str(v[1])).replace("'", "")
    df = df.withColumns({"box": F.expr(box), "start": F.expr(start), "close": F.expr(close)})
    df = df.withColumn("end", F.expr(f"greatest(least(start + {_whole('u_length', 120, 240)}, close), start + 120)"))

    def coord(hub: str, table: dict, k: int, u: str, spread: float) -> Column:
        base = F.expr(_by(hub, table, lambda v: f"{v[k]}D"))
        return rnd(base + (F.col(u) * 2.0 - 1.0) * spread, 4)

    clock = lambda c: F.concat(F.lit(f"{DAY}T"), F.format_string("%02d:%02d:00", F.floor(F.col(c) / 60), F.col(c) % 60))
    return df.select(
        F.format_string("SH%03d", F.col("id") + 1).alias("shipment_id"),
        coord("pickup_hub", HUBS, 0, "u_plat", HUB_SPREAD_DEG).alias("pickup_lat"),
        coord("pickup_hub", HUBS, 1, "u_plng", HUB_SPREAD_DEG).alias("pickup_lng"),
        coord("delivery_hub", DROPS, 0, "u_dlat", DROP_SPREAD_DEG).alias("delivery_lat"),
        coord("delivery_hub", DROPS, 1, "u_dlng", DROP_SPREAD_DEG).alias("delivery_lng"),
        "weight_kg",
        F.col("box.l").alias("length_cm"), F.col("box.w").alias("width_cm"), F.col("box.h").alias("height_cm"),
        clock("start").alias("earliest_delivery"), clock("end").alias("latest_delivery"),
        "goods_type", "pickup_hub", "delivery_hub",
    )
