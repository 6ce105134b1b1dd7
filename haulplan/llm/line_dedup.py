"""Lines that many shipments' texts share, found through a sharded perfect hash.

The distinct hashes of the shared lines are cut into shards by their leading
bits. A shard is one row: a minimal perfect hash and, at its indices, a
fingerprint, a document count and the keeper. Texts send the hashes of their
lines to the shards and probe the arrays there; no line text is joined. A line
that is not in a shard meets a foreign fingerprint (64 bits beside the 64 that
gave the index) and is left alone.

A shard that meets more lines than the mean, as one with a very common line
does, is copied under several salts in proportion to its lines, so no task
gathers a hot line. The shard arrays are small, which makes the copies cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, key_type, map_batches, mix64, repeat, rows_of, schema_of, shuffle_width, stages

#: The blanks stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
MOST_SHARDS = 65_536
_LEVEL_STEP = 0x9E3779B97F4A7C15


def line_keys(text: bytes, least_points: int) -> list[bytes | None]:
    """The key of each line of ``text``: stripped, A-Z lower-cased; None if too short."""
    keys = []
    for line in text.lower().split(b"\n"):
        key = line.strip(BLANKS)
        long = len(key) >= least_points and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_points)
        keys.append(key if long else None)
    return keys


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct 64-bit ``keys``: (bits of all levels, bits per level).

    Each level hashes the keys left over into twice as many bits; a bit hit by
    one key alone is that key's, and the others go down a level.
    """
    bits, sizes, left, level = [], [], keys.astype(np.uint64), 0
    while left.size:
        size = 2 * left.size
        at = _slots(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left, level = left[~alone[at]], level + 1
    return (np.concatenate(bits) if bits else np.zeros(0, bool)), np.array(sizes, np.int64)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * _LEVEL_STEP & 0xFFFFFFFFFFFFFFFF)
    return (mix64(keys ^ step) % np.uint64(size)).astype(np.int64)


def probe_index(bits: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, 0 .. n-1; -1 where no level has a bit for it."""
    rank = np.cumsum(bits) - 1
    found, base = np.full(keys.size, -1, np.int64), 0
    open_, keys = np.arange(keys.size), keys.astype(np.uint64)
    for level, size in enumerate(sizes):
        at = base + _slots(keys[open_], level, int(size))
        hit = bits[at]
        found[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + int(size)
    return found


def line_hashes(shipments: DataFrame, least_points: int) -> DataFrame:
    """(shipment_id, hi, lo): the 128-bit hash of each different line key of a row."""

    def hashes(batch: pa.RecordBatch) -> dict:
        digests, counts = [], []
        for text in as_bytes(rows_of(batch, "delivery_hub")):
            own = {xxhash.xxh3_128_digest(k) for k in line_keys(text, least_points) if k is not None}
            digests += own
            counts.append(len(own))
        both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        return {"shipment_id": repeat(rows_of(batch, "shipment_id"), counts), "hi": both[:, 0], "lo": both[:, 1]}

    columns = shipments.select("shipment_id", "delivery_hub")
    return map_batches(columns, hashes, f"shipment_id {key_type(shipments)}, hi long, lo long")


def shard_of(shards: int):
    return F.pmod(F.shiftrightunsigned("hi", 32), F.lit(shards)).cast("int")


def index_shards(shared: DataFrame, shards: int) -> DataFrame:
    """One row per shard: perfect hash, fingerprints, counts and keepers of its shared lines."""
    keeper = key_type(shared, "keeper")

    def build(table: pa.Table) -> pa.Table:
        hi = table["hi"].to_numpy().view(np.uint64)
        bits, sizes = build_index(hi)
        order = np.argsort(probe_index(bits, sizes, hi))
        return pa.table({
            "shard": table["shard"][:1], "bits": [np.packbits(bits).tobytes()], "sizes": [sizes.tobytes()],
            "prints": [table["lo"].to_numpy()[order].astype("<i8").tobytes()],
            "counts": [np.minimum(table["n"].to_numpy()[order], 2**32 - 1).astype("<u4").tobytes()],
            "keepers": [table["keeper"].take(pa.array(order)).to_pylist()],
        })

    def typed(table: pa.Table) -> pa.Table:
        out = build(table)
        return out.set_column(5, "keepers", out["keepers"].cast(pa.list_(table.schema.field("keeper").type)))

    rows = shared.select(shard_of(shards).alias("shard"), "hi", "lo", "n", "keeper")
    return rows.groupBy("shard").applyInArrow(
        typed, f"shard int, bits binary, sizes binary, prints binary, counts binary, keepers array<{keeper}>"
    )


def drop_shared_lines(
    shipments: DataFrame, least_points: int = 20, least_shipments: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Take shared lines out of every shipment's text but one.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys
    of at least ``least_points`` code points found in at least
    ``least_shipments`` shipments lose all their lines, except in the largest
    ``shipment_id`` holding them. The other lines stay, joined by newlines.

    Returns one row per input row: ``shipment_id``, ``n_lines`` (before),
    ``n_dropped``, ``delivery_hub`` (the text that stays), and the columns named
    in ``carry``. A null or empty text
    is one empty line. Rows that share an id are one shipment to the counts, and
    a null id counts as an id smaller than any other. An empty table gives no rows.
    """
    spark = shipments.sparkSession
    run = stages(spark, "lines")
    lines = run.save(line_hashes(shipments, least_points), "hashes")
    counted = lines.dropDuplicates().groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("shipment_id").alias("keeper"))
    counted = run.save(counted, "counts")
    shards = min(MOST_SHARDS, 4 * shuffle_width(spark))
    shared = counted.filter(F.col("n") >= least_shipments)
    index = index_shards(shared, shards)
    # a table of at most MOST_SHARDS rows: lines met by each shard against the mean
    load = counted.groupBy(shard_of(shards).alias("shard")).agg(F.sum("n").alias("met"))
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / shards
    salts = load.select("shard", F.ceil(F.col("met") / F.lit(max(mean, 1.0))).cast("int").alias("salts"))
    salts = F.broadcast(run.save(salts, "salts"))
    probes = (
        lines.withColumn("shard", shard_of(shards))
        .join(salts, "shard")
        .select("shard", F.pmod(F.xxhash64("shipment_id"), "salts").cast("int").alias("salt"), "shipment_id", "hi", "lo")
    )
    copies = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dropped = (
        probes.groupBy("shard", "salt")
        .cogroup(copies.groupBy("shard", "salt"))
        .applyInArrow(_probe(least_shipments), f"shipment_id {key_type(shipments)}, hi long, lo long")
    )
    per_text = (
        dropped.groupBy("shipment_id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))
        .select(F.col("shipment_id").alias("_id"), F.col("gone.hi").alias("hi"), F.col("gone.lo").alias("lo"))
    )
    joined = shipments.select("shipment_id", "delivery_hub", *carry).join(per_text, F.col("shipment_id").eqNullSafe(F.col("_id")), "left")
    return map_batches(
        joined.drop("_id"), _rewrite(least_points, ("shipment_id", *carry)),
        f"{schema_of(shipments, ('shipment_id', *carry))}, n_lines long, n_dropped long, delivery_hub string",
    )


def _probe(least_shipments: int):
    def probe(lines: pa.Table, shard: pa.Table) -> pa.Table:
        out = lines.select(["shipment_id", "hi", "lo"])
        if not shard.num_rows or not lines.num_rows:
            return out.slice(0, 0)
        row = shard.slice(0, 1).to_pylist()[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        at = probe_index(bits, sizes, out["hi"].to_numpy().view(np.uint64))
        prints, counts = np.frombuffer(row["prints"], "<i8"), np.frombuffer(row["counts"], "<u4")
        known = (at >= 0) & (prints[at] == out["lo"].to_numpy()) & (counts[at] >= least_shipments)
        keepers = row["keepers"]
        ids = out["shipment_id"].to_pylist()
        known &= np.fromiter((keepers[a] != i for a, i in zip(at, ids)), bool, len(ids))
        return out.filter(pa.array(known))

    return probe


def _rewrite(least_points: int, handed: tuple[str, ...]):
    def rewrite(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(rows_of(batch, "delivery_hub"))
        his, los = rows_of(batch, "hi").to_pylist(), rows_of(batch, "lo").to_pylist()
        n_lines, n_dropped, kept = [], [], []
        for text, hi, lo in zip(texts, his, los):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if hi:
                packed = np.array([hi, lo], ">i8").T.tobytes()
                gone = {packed[i : i + 16] for i in range(0, len(packed), 16)}
                keys = line_keys(text, least_points)
                lines = [x for x, k in zip(lines, keys) if k is None or xxhash.xxh3_128_digest(k) not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines))
        return {c: rows_of(batch, c) for c in handed} | {
            "n_lines": pa.array(n_lines, pa.int64()),
            "n_dropped": pa.array(n_dropped, pa.int64()), "delivery_hub": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    return rewrite
