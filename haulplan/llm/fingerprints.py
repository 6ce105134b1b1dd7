"""Fingerprints by locally consistent parsing.

Deterministic coin tossing turns the symbols of a text into small labels that
depend on their left neighbours alone; places where a label is a local minimum
end a phrase. A phrase is named by a hash of the symbols in it, and the names
are the symbols of the next level. Whether a place ends a phrase depends on a
few symbols around it, so equal substrings of any two texts are cut alike
except near their ends, whatever their offset, and share the names inside.
A text's fingerprint is the bottom-k sketch of its phrase names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_type, map_batches, rows_of, shuffle_width

LEVELS = 2
SKETCH = 64
_PLACE = np.zeros(37, np.uint8)
_PLACE[[pow(2, i, 37) for i in range(32)]] = np.arange(32)  # 2^i differ modulo 37


def mix32(x: np.ndarray) -> np.ndarray:
    """The 32-bit finisher of MurmurHash3, a public mixing function."""
    x = x.astype(np.uint32, copy=True)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def coin_toss(labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One round: the lowest bit in which a label differs from its left neighbour, and that bit's value.

    Neighbours that differ keep different labels; b-bit labels shrink to log b
    bits. ``starts`` are the first places of the texts, which have no neighbour.
    """
    differ = np.empty_like(labels)
    np.bitwise_xor(labels[1:], labels[:-1], out=differ[1:])
    differ[starts] = 1
    low = differ & (~differ + labels.dtype.type(1))
    place = _PLACE[low % labels.dtype.type(37)]
    return (place << np.uint8(1)) | ((labels >> place) & labels.dtype.type(1)).astype(np.uint8)


def phrases(symbols: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of ``symbols`` and the text each belongs to.

    ``texts`` numbers the text of every symbol; a phrase never crosses texts.
    Runs of one symbol are taken together first, named by symbol and length.
    """
    fresh = np.ones(symbols.size, bool)
    np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
    turn = texts[1:] != texts[:-1]
    fresh[1:] |= turn
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, symbols.size)).astype(np.uint32)
    symbols, texts = mix32(symbols[at] + (runs - np.uint32(1)) * np.uint32(0x9E3779B9)), texts[at]
    starts = np.append(0, np.flatnonzero(texts[1:] != texts[:-1]) + 1)
    labels = symbols
    for _ in range(3):
        labels = coin_toss(labels, starts)
    ends = np.zeros(symbols.size, bool)
    ends[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] <= labels[2:])
    ends[starts] = False
    ends[starts[1:] - 1] = True
    ends[-1] = True
    last = np.flatnonzero(ends)
    first = np.append(0, last[:-1] + 1)
    within = (np.arange(symbols.size) - np.repeat(first, last - first + 1)).astype(np.uint32)
    sums = np.add.reduceat(mix32(symbols + within * np.uint32(0x7FEB352D)), first)
    return mix32(sums + (last - first).astype(np.uint32)), texts[last]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Bottom-k of the 32-bit phrase names of each text, ascending; a text without characters has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names, owner = mix32(points + np.uint32(1)), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    if not names.size:
        return [np.zeros(0, np.uint32)] * len(texts)
    for _ in range(LEVELS):
        names, owner = phrases(names, owner)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(32)) | names.astype(np.uint64))
    owners = (keys >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(owners, np.arange(len(texts) + 1))
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + SKETCH)] for a, b in zip(bounds[:-1], bounds[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, from two sketches alone; two empty ones are alike."""
    both = np.union1d(a, b)[:SKETCH]
    if not both.size:
        return 1.0
    return float(np.isin(both, a, assume_unique=True).__and__(np.isin(both, b, assume_unique=True)).mean())


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(shipments: DataFrame) -> DataFrame:
    """``shipment_id`` and ``fingerprint`` (hex of the sketch) of every shipment's whole text.

    Equal texts have equal fingerprints, texts without characters the empty
    one. One row per input row; an empty table gives none.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in rows_of(batch, "delivery_hub").to_pylist()]
        prints = [written(s) for part in _parts(texts) for s in sketches(part)]
        return {"shipment_id": rows_of(batch, "shipment_id"), "fingerprint": pa.array(prints, pa.string())}

    return map_batches(
        shipments.select("shipment_id", "delivery_hub"), run, f"shipment_id {key_type(shipments)}, fingerprint string"
    )


def _parts(texts: list[str], points: int = 400_000):
    """Consecutive texts of about ``points`` characters; a longer text stands alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > points:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


#: Sampled text ids for each range they are cut into.
_SAMPLED = 32


def _ranges(rows: DataFrame, ranges: int) -> tuple[Column, list]:
    """What ids are ordered by, and cuts between ranges, largest first.

    Numbers are cut at approximate quantiles. Text ids are compared whole: their
    cuts come from the distinct ids with the smallest hashes, ``_SAMPLED`` a
    range. The cuts only balance the ranges; any cuts give the same result.
    """
    if key_type(rows) == "string":
        ids = rows.filter("shipment_id IS NOT NULL").groupBy("shipment_id").agg(F.first(F.xxhash64("shipment_id")).alias("h"))
        few = sorted(r["shipment_id"] for r in ids.orderBy("h", "shipment_id").limit(ranges * _SAMPLED).collect())
        return F.col("shipment_id"), sorted({few[len(few) * i // ranges] for i in range(1, ranges)} if few else (), reverse=True)
    order = F.col("shipment_id").cast("double")
    cuts = rows.select(order.alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    return order, sorted(set(cuts), reverse=True)


def with_next(shipments: DataFrame) -> DataFrame:
    """Texts laid out so that each stands before the next one by descending ``shipment_id``.

    Ids are cut into ranges (a bounded list of cuts, see ``_ranges``); a range is one sorted
    partition, followed by a copy of the first row of the next range (of the
    first range for the last), marked ``guest``. The texts move once, and no
    task sees more than a range. Ties stand in the order of their texts; a null
    id stands last.
    """
    spark = shipments.sparkSession
    ranges = max(2, 2 * shuffle_width(spark))
    rows = shipments.select("shipment_id", F.coalesce("delivery_hub", F.lit("")).alias("delivery_hub"))
    order, cuts = _ranges(rows, ranges)
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    # ranges count up as ids go down
    rows = rows.withColumn("range", F.when(order.isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(bounds, lambda c: c > order))))
    first = [F.desc_nulls_last("shipment_id"), F.asc("delivery_hub")]
    top = rows.groupBy("range").agg(F.max("shipment_id").alias("top"))
    tops = {r["range"]: r["top"] for r in top.collect()}  # one id per range
    if not tops:
        return rows.withColumn("guest", F.lit(False))
    present = sorted(tops)
    before = dict(zip(present, present[-1:] + present[:-1]))
    is_top = F.col("shipment_id").isin([t for t in tops.values() if t is not None])
    chosen = rows.filter(is_top | F.col("shipment_id").isNull() if None in tops.values() else is_top)
    chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy(*first))).filter("nth = 1").drop("nth")
    to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
    guests = chosen.withColumn("range", to).withColumn("guest", F.lit(True))
    everyone = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return everyone.repartition(ranges, "range").sortWithinPartitions("range", "guest", *first)


def edited_fingerprints(shipments: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form and the likeness to both it and the next text.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next text in descending ``shipment_id``; after the
    last comes the first, so a single row is its own next.

    Returns ``shipment_id``, ``n_chars``, ``edited``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``; one row per input
    row, null texts as empty ones.
    """
    laid = with_next(shipments)

    def run(batches):
        held = None  # the last row seen, still without its next
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(rows_of(batch, n).to_pylist() for n in ("shipment_id", "range", "guest", "delivery_hub"))))
            rows = [held, *rows] if held else rows
            for part in _parts_of(rows):
                out = _pairs(part)
                if out is not None:
                    yield out
            held = rows[-1]

    columns = "n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return laid.mapInArrow(run, f"shipment_id {key_type(shipments)}, {columns}")


def _parts_of(rows: list[tuple], points: int = 300_000):
    """Runs of consecutive rows that overlap by one row."""
    start, size = 0, 0
    for i, row in enumerate(rows):
        size += len(row[3])
        if size > points and i > start:
            yield rows[start : i + 1]
            start, size = i, len(row[3])
    if len(rows) - start > 1:
        yield rows[start:]


def _pairs(rows: list[tuple]) -> pa.RecordBatch | None:
    """Results of all rows but the last; guests only lend their text."""
    own = [i for i in range(len(rows) - 1) if not rows[i][2]]
    if not own:
        return None
    texts = [r[3] for r in rows]
    edited = []
    for i in own:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    plain, changed = sketches(texts), sketches(edited)
    return pa.RecordBatch.from_pydict({
        "shipment_id": [rows[i][0] for i in own], "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
        "edited": edited, "fingerprint": [written(plain[i]) for i in own],
        "edited_fingerprint": [written(c) for c in changed],
        "near_edited": [likeness(plain[i], c) for i, c in zip(own, changed)],
        "near_next": [likeness(plain[i], plain[i + 1]) for i in own],
    })
