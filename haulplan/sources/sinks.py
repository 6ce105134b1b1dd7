"""Report sinks: parquet, CSV or JSON, partitioned by scenario where present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition: str = "scenario_id") -> None:
    if fmt == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.format(fmt).save(path)
