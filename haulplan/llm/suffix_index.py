"""Long repeated byte strings by a logarithmic family of suffix arrays.

Texts arrive in batches. A batch gets a suffix array: its suffixes in an order that
puts equal beginnings together, each with its text and position. It is merge-scanned
against every level of the family for suffixes with the same beginning, and becomes
level 0; equal levels merge into the next one, so a suffix is rewritten a logarithmic
number of times. Levels are tables sorted and bucketed by the order's key, so a scan
reads both sides in order and shuffles nothing. A family is kept under a name and can
be opened again for later batches.

Only matches of ``match`` bytes matter, which keeps the arrays sparse and their order
short: they hold the suffixes that start at anchors (the lowest gram hash among
``width`` neighbours, so that equal strings have equal anchors whatever their
offset), ordered by the hash of their first ``match - width + 1`` bytes. Every
string of ``match`` bytes holds its anchor's beginning whole.

A beginning that occurs again makes its strings candidates. Strings of one
anchor whose whole surroundings occur again are settled together; the others,
near the ends of a match, are looked at again with narrower anchors, at last one
by one. The result is exact up to 128-bit hash collisions.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Stages
from .common import as_bytes, key_type, map_batches, mix64, rows_of, shuffle_width, stages

MATCH = 400
#: Anchor widths from coarse to exact.
WIDTHS = (320, 24, 1)
BATCHES = 4
#: Bytes of a passage of about fifty words, and the anchor width that finds it.
PASSAGE = 280
PASSAGE_WIDTH = 96
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PART_BYTES = 1 << 20
#: A class with over one in so many entries is hot; there are fewer such classes than this.
MOST_HOT = 1024


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class RangeHashes:
    """Hashes of any range of a byte string from running sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(_BASE, data.size), out=self.sums[1:])
        self.back = _powers(_INVERSE, data.size + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def lowest_grams(data: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the 8-byte gram of the lowest hash among the next ``width`` starts; the first of equals."""
    n = data.size - 7
    if width == 1:
        return np.arange(n)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    hashed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    ranked = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = np.append(ranked, np.full(-n % width + width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchored(texts: list[bytes], ranges: list[list[tuple[int, int]] | None], width: int, match: int) -> tuple[np.ndarray, ...]:
    """Entries (text, first, last, key, whole) of the strings that start within ``ranges`` (ends included; None: all).

    An entry is a run of strings with one anchor: ``key`` hashes the anchor's
    beginning, ``whole`` all bytes of the strings and where the anchor lies.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    spans = [(i, 0, len(t) - match) for i, t in enumerate(texts) if ranges[i] is None and len(t) >= match]
    spans += [(i, a, b) for i, own in enumerate(ranges) if own is not None for a, b in own]
    spans.sort()
    if not spans:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    data = np.frombuffer(b"".join(texts) + bytes(match + 8), np.uint8)
    owner, low, high = np.array(spans, np.int64).T
    count = high - low + 1
    text = np.repeat(owner, count)
    place = np.repeat(starts[owner] + low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    anchor = lowest_grams(data, width)[place]
    fresh = np.ones(place.size, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], place.size) - 1
    text, anchor, first, last = text[first], anchor[first], place[first], place[last]
    hashes = RangeHashes(data)
    key = hashes.of(anchor, anchor + match - width + 1)
    whole = mix64(hashes.of(first, last + match) + mix64((anchor - first).astype(np.uint64)))
    return text, first - starts[text], last - starts[text], key, whole


def entries(rows: DataFrame, width: int, match: int) -> DataFrame:
    """(row, tag, first, last, key, whole) of all strings, or of those within ``open`` if there is such a column."""
    some = "open" in rows.columns

    def run(batch: pa.RecordBatch) -> dict | None:
        texts = as_bytes(rows_of(batch, "delivery_hub"))
        ranges = rows_of(batch, "open").to_pylist() if some else None
        parts, start, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= _PART_BYTES or i + 1 == len(texts):
                own = [[(r["first"], r["last"]) for r in x] for x in ranges[start : i + 1]] if some else [None] * (i + 1 - start)
                found = anchored(texts[start : i + 1], own, width, match)
                parts.append((found[0] + start, *found[1:]))
                start, size = i + 1, 0
        text, first, last, key, whole = (np.concatenate(x) for x in zip(*parts))
        at = pa.array(text)
        return {
            "row": rows_of(batch, "row").take(at), "tag": rows_of(batch, "tag").take(at),
            "first": first.astype(np.int32), "last": last.astype(np.int32), "key": key.view(np.int64), "whole": whole.view(np.int64),
        }

    columns = ["row", "tag", "delivery_hub", *(["open"] if some else [])]
    schema = "row long, tag int, first int, last int, key long, whole long"
    return map_batches(rows.select(*columns), run, schema)


class SuffixFamily:
    """The index family ``name``: level i holds the sorted suffixes of 2^i batches, with text and position.

    Levels are catalog tables ``<name>_<i>_<n>``; a family of that name that exists is opened.
    """

    _COLUMNS = ("key", "row", "tag", "first", "last", "whole", "entry")

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.buckets, self.n = spark, name, shuffle_width(spark), 0
        self.levels: dict[int, str] = {}
        for table in spark.catalog.listTables(pattern=f"{name}_*"):
            level, n = map(int, table.name[len(name) + 1 :].split("_"))
            self.levels[level] = table.name
            self.n = max(self.n, n)

    def _save(self, level: int, suffixes: DataFrame) -> str:
        self.n += 1
        table = f"{self.name}_{level}_{self.n}"
        suffixes.select(*self._COLUMNS).repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(table)
        return table

    def add(self, batch: DataFrame, run: Stages) -> DataFrame:
        """Index the suffixes of a batch (``entries``); returns every suffix, of the batch or of a level, that has a partner in the batch.

        ``entry`` names a suffix for good: one of a level is returned again by every batch that meets it.
        """
        # repeated rows are suffixes of their own
        entry = F.xxhash64(F.lit(f"{self.name} {self.n}"), F.monotonically_increasing_id())
        spark, own = self.spark, self._save(0, batch.withColumn("entry", entry))
        new, hits = spark.table(own), []
        keys = new.groupBy("key").agg(F.count("*").alias("n"))  # in place: buckets hold keys whole
        keys = run.save(keys, f"{own}_keys")
        met = keys.filter("n > 1").select("key")
        for level in self.levels.values():
            there = spark.table(level)
            hits.append(there.join(keys.select("key"), "key", "left_semi"))
            met = met.union(keys.select("key").join(there.select("key"), "key", "left_semi"))
        hits.append(new.join(run.save(met.distinct(), f"{own}_met"), "key", "left_semi"))
        found = hits[0]
        for more in hits[1:]:
            found = found.union(more)
        found = run.save(found.select(*self._COLUMNS), f"{own}_found")
        level, equal = 0, [own]
        while level in self.levels:  # equal levels merge into the next
            equal.append(self.levels.pop(level))
            level += 1
        if len(equal) > 1:
            merged = spark.table(equal[0])
            for table in equal[1:]:
                merged = merged.union(spark.table(table))
            own = self._save(level, merged)
            for table in equal:
                spark.sql(f"DROP TABLE {table}")
        self.levels[level] = own
        return found

    def drop(self) -> None:
        for table in self.levels.values():
            self.spark.sql(f"DROP TABLE {table}")
        self.levels = {}


def settle(found: DataFrame, run: Stages, name: str) -> DataFrame:
    """``found`` entries with ``again`` (its strings occur again) and ``open`` (its strings need a closer look).

    Entries alike in ``key`` and ``whole`` are one class. Classes of one key
    differ near the ends of a match: their single entries stay open, and one
    entry of each other class, for the singles to be compared with.
    """
    place = F.xxhash64("row", "tag", "first")
    classes = found.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(place).alias("sample"))
    mixed = classes.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key")
    mixed = run.save(mixed, name)
    mixed = classes.join(mixed.withColumn("mixed", F.lit(True)), "key", "left")
    told = mixed.filter("n > 1 OR mixed").select("key", "whole", "n", "sample", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    told = run.save(told, f"{name}_classes")
    # classes with a large share of all entries: few by that share, so they go to the entries
    share = max((told.agg(F.sum("n")).first()[0] or 0) // MOST_HOT, 1)
    hot, cool = F.broadcast(told.filter(F.col("n") > share)), told.filter(F.col("n") <= share)
    names = hot.select("key", "whole")
    joined = found.join(hot, ["key", "whole"]).unionByName(found.join(names, ["key", "whole"], "left_anti").join(cool, ["key", "whole"]))
    return joined.select(
        "row", "tag", "first", "last", (F.col("n") > 1).alias("again"),
        (F.col("mixed") & (place == F.col("sample"))).alias("open"),
    )


def _joined(texts: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    """Joined by the bucket's column alone, so that the texts stay where they are; ``tag`` is checked beside it."""
    more = per_text.withColumnsRenamed({"row": "_row", "tag": "_tag"})
    return texts.join(more, (F.col("row") == F.col("_row")) & (F.col("tag") - F.col("_tag").cast("long") == 0), how).drop("_row", "_tag")


def _per_text(told: DataFrame, which: str) -> DataFrame:
    return told.filter(which).groupBy("row", "tag").agg(F.collect_list(F.struct("first", "last")).alias(which))


def shared_passages(rows: DataFrame, run: Stages, width: int, match: int) -> DataFrame:
    """(row, tag, n_passages): anchors of a text whose beginning stands elsewhere too.

    Two places that share ``match`` bytes share an anchor of ``width`` within; one that is
    counted shares at least ``match - width + 1`` bytes.
    """
    own = run.save(entries(rows, width, match).select("row", "tag", "first", "key"), "passages")
    again = own.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met = own.join(run.save(again, "passage_keys"), "key", "left_semi")
    return met.groupBy("row", "tag").agg(F.count("*").alias("n_passages"))


def remove_repeats(shipments: DataFrame, match: int = MATCH, batches: int = BATCHES, passage: int = PASSAGE) -> DataFrame:
    """Remove every byte covered by a ``match``-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross texts, and the other place may
    be in the same text. Strings are judged on the input. Rows that share an id
    are texts of their own, and repeated rows repeat all their strings.

    Returns one row per input row: ``shipment_id``, ``n_bytes``, ``n_removed``,
    ``spans`` (array of (start, end) of the maximal removed runs), ``kept`` (the
    remaining bytes; they may end within a character), and ``n_passages``: places
    of shorter passages, of ``passage`` bytes or more, that stand elsewhere too.
    These are only counted (see ``shared_passages``), not removed. Null is an empty text. An
    empty table gives no rows. The project's records hold no long texts of
    their own; any free text will do.
    """
    spark = shipments.sparkSession
    run, buckets = stages(spark, "suffixes"), shuffle_width(spark)
    text = F.coalesce("delivery_hub", F.lit(""))
    # id and text name a row, by 96 bits; the hash of a null id is its seed
    rows = shipments.select(
        F.xxhash64("shipment_id", text).alias("row"), F.hash(text).alias("tag"), "shipment_id", text.alias("delivery_hub")
    )
    name = f"haulplan_texts_{uuid.uuid4().hex}"
    # one shuffle of the texts; every later pass joins them in place
    rows.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    all_entries = entries(texts, WIDTHS[0], match).withColumn("batch", F.pmod(F.shiftright("row", 8), F.lit(batches)).cast("int"))
    all_entries = run.save(all_entries, "entries")
    family, hits = SuffixFamily(spark, f"haulplan_suffixes_{uuid.uuid4().hex}"), None
    for batch in range(batches):
        more = family.add(all_entries.filter(F.col("batch") == batch).drop("batch"), run)
        hits = more if hits is None else hits.union(more)
    family.drop()
    # a suffix of a level is returned by every later batch that meets it
    found = run.save(hits.dropDuplicates(["entry"]).drop("entry"), "found")
    told = run.save(settle(found, run, "mixed0"), "told0")
    again = told.filter("again")
    for i, width in enumerate(WIDTHS[1:], 1):
        closer = entries(_joined(texts, _per_text(told, "open"), "inner"), width, match)
        told = run.save(settle(run.save(closer, f"closer{i}"), run, f"mixed{i}"), f"told{i}")
        again = again.union(told.filter("again"))
    marks = _per_text(again, "again").join(shared_passages(texts, run, PASSAGE_WIDTH, passage), ["row", "tag"], "full")
    return map_batches(
        _joined(texts, marks, "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0))), _cut(match),
        f"shipment_id {key_type(shipments)}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, n_passages long",
    )


def _cut(match: int):
    def cut(batch: pa.RecordBatch) -> dict:
        n_bytes, removed, spans, kept = [], [], [], []
        for text, again in zip(as_bytes(rows_of(batch, "delivery_hub")), rows_of(batch, "again").to_pylist()):
            own: list[list[int]] = []
            for start, end in sorted((r["first"], r["last"] + match) for r in again or ()):
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([start, end])
            edges = [0, *(x for s in own for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            n_bytes.append(len(text))
            removed.append(len(text) - len(kept[-1]))
            spans.append([{"start": a, "end": b} for a, b in own])
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return {
            "shipment_id": rows_of(batch, "shipment_id"), "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(span)), "kept": pa.array(kept, pa.binary()),
            "n_passages": rows_of(batch, "n_passages"),
        }

    return cut
