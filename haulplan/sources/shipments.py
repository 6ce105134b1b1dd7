"""Shipment input: CSV files, and the view over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("pickup_lat", "pickup_lng", "weight_kg", "earliest_delivery", "latest_delivery")

CSV_TYPES = {
    "shipment_id": "string",
    "pickup_lat": "double",
    "pickup_lng": "double",
    "delivery_lat": "double",
    "delivery_lng": "double",
    "weight_kg": "double",
    "length_cm": "int",
    "width_cm": "int",
    "height_cm": "int",
    "earliest_delivery": "string",
    "latest_delivery": "string",
    "goods_type": "string",
    "pickup_hub": "string",
    "delivery_hub": "string",
}

# Pickup hubs and destinations of the view, (name, lat, lng).
HUBS = (
    ("Bhiwandi", 19.296, 73.066), ("Taloja", 18.903, 73.111), ("Chakan", 18.658, 73.773),
    ("Pimpri", 18.534, 73.854), ("Thane", 19.218, 72.978), ("Nashik", 20.011, 73.765),
    ("Surat", 21.170, 72.831), ("Vadodara", 22.307, 73.181), ("Ahmedabad", 22.980, 72.499),
    ("Bangalore", 12.971, 77.594),
)
DESTINATIONS = (
    ("Pune DC", 18.520, 73.856), ("Surat WM", 21.195, 72.830), ("Ahmedabad CFS", 23.022, 72.571),
    ("Nagpur", 21.146, 79.088), ("Hyderabad", 17.385, 78.487), ("Chennai", 13.067, 80.237),
    ("Mumbai BKC", 19.076, 72.877), ("Kanpur", 26.449, 80.331), ("Delhi NCR", 28.613, 77.209),
    ("Kolkata", 22.794, 88.328), ("Hubli", 15.317, 75.135), ("Kolhapur", 16.704, 74.243),
)
GOODS = (
    "automotive_parts", "fmcg_packaged_goods", "construction_material", "textiles_apparel",
    "chemicals_industrial", "pharma_medical", "electronics", "steel_metal_parts",
)


def read_shipments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a shipment CSV with declared types; unknown columns stay as text.

    A row that does not parse keeps its raw line in ``corrupt_record``.
    """
    names = spark.read.csv(path, header=True, enforceSchema=False).columns
    missing = sorted(set(REQUIRED) - set(names))
    if missing:
        raise ValueError(f"CSV lacks required columns: {', '.join(missing)}")
    schema = ", ".join(f"`{n}` {CSV_TYPES.get(n, 'string')}" for n in names)
    return spark.read.csv(
        path,
        header=True,
        schema=f"{schema}, corrupt_record string",
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="corrupt_record",
        enforceSchema=True,
    )


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def shipments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments derived from lineitem, orders and part.

    The hub lists are short fixed arrays, so only the two table joins remain.
    Orders grow with the lineitems, so that join is always a sort-merge join.
    Windows are minutes of the planning week ``ship_week``.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    c = F.col
    hub, dst = c("l_suppkey") % 10, c("o_custkey") % 12

    def offset(expr: Column, span: int) -> Column:
        return ((expr % span) - (span - 1) // 2).cast("double") / F.lit(1000.0)

    start = (c("l_partkey") * 13 + c("l_linenumber") * 41) % 600
    return (
        li.join(orders.hint("merge"), c("l_orderkey") == c("o_orderkey"))
        .join(part, c("l_partkey") == c("p_partkey"))
        .select(
            F.concat_ws(
                "-",
                c("l_orderkey").cast("string"),
                c("l_linenumber").cast("string"),
                c("l_partkey").cast("string"),
                c("l_suppkey").cast("string"),
                c("l_quantity").cast("int").cast("string"),
            ).alias("shipment_id"),
            (_pick([h[1] for h in HUBS], hub) + offset(c("l_partkey"), 121)).alias("pickup_lat"),
            (_pick([h[2] for h in HUBS], hub) + offset(c("l_suppkey") * 7 + c("l_linenumber"), 121)).alias("pickup_lng"),
            (_pick([d[1] for d in DESTINATIONS], dst) + offset(c("o_custkey"), 141)).alias("delivery_lat"),
            (_pick([d[2] for d in DESTINATIONS], dst) + offset(c("o_custkey") * 3 + c("l_linenumber"), 141)).alias("delivery_lng"),
            (
                c("l_quantity") * F.when(c("l_linenumber") == 7, 450.0).otherwise(180.0)
                + (c("p_size") * 10).cast("double")
            ).alias("weight_kg"),
            (60 + (c("p_partkey") * 37) % 460).cast("int").alias("length_cm"),
            (50 + (c("p_partkey") * 17) % 160).cast("int").alias("width_cm"),
            (40 + (c("p_partkey") * 29) % 150).cast("int").alias("height_cm"),
            F.to_date(F.date_trunc("week", c("l_shipdate"))).alias("ship_week"),
            (360 + start).cast("int").alias("earliest_min"),
            (480 + start + (c("l_suppkey") * 11) % 121).cast("int").alias("latest_min"),
            _pick(GOODS, c("p_partkey") % 8).alias("goods_type"),
            _pick([h[0] for h in HUBS], hub).alias("pickup_hub"),
            _pick([d[0] for d in DESTINATIONS], dst).alias("delivery_hub"),
        )
    )


def planning_rows(view: DataFrame) -> DataFrame:
    """The view in the planner's input form: a period and windows in seconds."""
    return view.select(
        "shipment_id",
        F.col("ship_week").cast("string").alias("period"),
        "pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng", "weight_kg",
        "length_cm", "width_cm", "height_cm",
        (F.col("earliest_min").cast("long") * 60).alias("earliest_s"),
        (F.col("latest_min").cast("long") * 60).alias("latest_s"),
        "goods_type", "pickup_hub", "delivery_hub",
    )
