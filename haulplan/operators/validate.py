"""Row checks: required fields, windows, coordinates, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources.shipments import REQUIRED


def _blank(name: str, dtype: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def missing_required(df: DataFrame, required=REQUIRED) -> Column:
    types = dict(df.dtypes)
    out = F.lit(False)
    for name in required:
        out = out | _blank(name, types[name])
    return out


def required_rows(df: DataFrame, required=REQUIRED) -> DataFrame:
    """Keep rows that have every required field."""
    return df.filter(~missing_required(df, required))


def coord_error(lat: str, lng: str) -> Column:
    """Why a coordinate is unusable, or null when it is fine."""
    region = "{} BETWEEN {}D AND {}D AND {} BETWEEN {}D AND {}D".format(lat, *K.REGION_LAT, lng, *K.REGION_LNG)
    return F.expr(
        f"""CASE WHEN {lat} IS NULL OR {lng} IS NULL THEN 'missing'
                 WHEN isnan({lat}) OR isnan({lng}) THEN 'nan'
                 WHEN abs({lat}) = double('Infinity') OR abs({lng}) = double('Infinity') THEN 'infinite'
                 WHEN NOT {lat} BETWEEN -90D AND 90D THEN 'latitude out of range'
                 WHEN NOT {lng} BETWEEN -180D AND 180D THEN 'longitude out of range'
                 WHEN NOT ({region}) THEN 'outside region' END"""
    )


def window_seconds(df: DataFrame) -> DataFrame:
    """Parse the ISO text windows once, into seconds."""
    return df.withColumns(
        {
            "earliest_s": F.try_to_timestamp("earliest_delivery").cast("long"),
            "latest_s": F.try_to_timestamp("latest_delivery").cast("long"),
        }
    )


def reject_reason(df: DataFrame) -> Column:
    """First reason to turn a row away, null for a valid one.

    Expects ``earliest_s`` and ``latest_s``. A finite coordinate outside the
    region stays valid and gets the place name ``invalid_coord``.
    """
    finite = F.lit(True)
    for name in ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng"):
        c = F.col(name)
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    reason = F.lit(None)
    if "corrupt_record" in df.columns:
        reason = F.when(F.col("corrupt_record").isNotNull(), "corrupt_record")
    else:
        reason = F.when(F.lit(False), "")
    if "earliest_delivery" in df.columns:
        reason = reason.when(missing_required(df), "missing_required")
    return (
        reason.when(F.col("earliest_s").isNull() | F.col("latest_s").isNull(), "bad_time")
        .when(F.col("earliest_s") >= F.col("latest_s"), "empty_window")
        .when(~finite, "bad_coordinate")
        .when(F.col("weight_kg").isNull() | F.isnan("weight_kg") | ~(F.col("weight_kg") > 0), "bad_weight")
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``); together the input."""
    marked = df.withColumn("reject_reason", reject_reason(df))
    valid = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason", "corrupt_record")
    return valid, marked.filter(F.col("reject_reason").isNotNull())


def csv_planning_rows(valid: DataFrame, period: Column | None = None) -> DataFrame:
    """Validated CSV rows in the planner's input form.

    Without ``period`` the day of the earliest delivery is the planning run. A
    row without an id is named by a digest of its own content.
    """
    cols = set(valid.columns)

    def opt(name: str, dtype: str, default=None) -> Column:
        if name in cols:
            c = F.col(name).cast(dtype)
            return (F.coalesce(c, F.lit(default)) if default is not None else c).alias(name)
        return F.lit(default).cast(dtype).alias(name)

    content = F.md5(F.to_json(F.struct(*[F.col(c) for c in valid.columns if c != "shipment_id"])))
    unnamed = F.concat(F.lit("row-"), content)
    own_id = F.coalesce(F.nullif(F.trim(F.col("shipment_id").cast("string")), F.lit("")), unnamed) if "shipment_id" in cols else unnamed
    return valid.select(
        own_id.alias("shipment_id"),
        (period if period is not None else F.to_date(F.timestamp_seconds("earliest_s"))).cast("string").alias("period"),
        "pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng", "weight_kg",
        opt("length_cm", "int"), opt("width_cm", "int"), opt("height_cm", "int"),
        "earliest_s", "latest_s",
        opt("goods_type", "string", "unknown"), opt("pickup_hub", "string"), opt("delivery_hub", "string"),
    )
