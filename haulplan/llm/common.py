"""Helpers the operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import Stages


def stages(spark: SparkSession, name: str) -> Stages:
    """Stage tables below the shared checkpoint folder, one folder per run."""
    run = Stages(spark)
    run.root = f"{run.root}-{name}"
    return run


def key_type(df: DataFrame, column: str = "shipment_id") -> str:
    return df.schema[column].dataType.simpleString()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes without decoding; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``fn`` turns a record batch into columns; Spark's rows stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch) if batch.num_rows else None
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, columns: tuple[str, ...]) -> str:
    """DDL of columns that a step hands through."""
    return ", ".join(f"`{c}` {key_type(df, c)}" for c in columns)


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def repeat(column: pa.Array, counts) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(column)), counts)))


#: Words over this many characters are worked out anew each time, so a memory's entries bound its bytes.
LONGEST_REMEMBERED = 64


def worker_memory(name: str, version: str = "") -> dict:
    """A dict that lives as long as the Python worker: functions come anew with each task, and their globals with them.

    There is one dict per purpose; another version of it, such as another fit, takes the place of the last.
    """
    held = sys.__dict__.setdefault("_haulplan_memory", {})
    if held.get(name, ("",))[0] != version or name not in held:
        held[name] = (version, {})
    return held[name][1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, a public 64-bit mixing function."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
