"""Similarity join of texts on their word n-grams by chosen paths.

Each text is the set of its n-grams. A path is a sequence of n-grams; a set
follows a path as long as it holds the next n-gram and a hash seeded by the
path so far chooses it, about ``BRANCHES`` n-grams a step whatever the set's
size. Similar sets choose alike, so they meet in the bucket of a path; large
buckets are split by a further step, small ones are compared by brute force on
sketches. Runs with other seeds repeat this until the expected recall is met.

What the buckets link only gathers candidates. Equal sets are one vertex from
the start; each group of linked vertices is then verified on its whole sets,
in blocks of bounded size, by exact intersections.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .common import as_bytes, key_type, map_batches, mix64, rows_of, shuffle_width, stages
from .components import components
from .suffix_index import RangeHashes

WORDS = 5
THRESHOLD = 0.8
BRANCHES = 2.0
DEPTH = 3
#: Most members of a bucket that is compared by brute force.
BUCKET = 100
#: Sketch likeness to a large bucket's head: from FAR on a candidate, from NEAR on settled.
FAR, NEAR = 0.3, 0.7
#: Sets of one block of the exact comparison.
BLOCK = 512
_SLOTS = 64
_EMPTY = 0xFFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PART_BYTES = 1 << 20


def _salt(k: int) -> np.uint64:
    return np.uint64(int(_STEP) * k % 2**64)


def runs_for(recall: float, threshold: float, branches: float = BRANCHES, depth: int = DEPTH) -> int:
    """Runs after which a pair at ``threshold`` has met with probability ``recall``.

    A pair's shared choices branch by ``branches`` times its overlap; a run
    misses if they die out before the last step.
    """
    shared, dies = branches * 2 * threshold / (1 + threshold), 0.0
    for _ in range(depth):
        dies = math.exp(-shared * (1 - dies))
    return math.ceil(math.log(1 - recall) / math.log(dies))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Ascending 64-bit hashes of each text's n-grams of blank-separated words, A-Z lower-cased.

    A text of fewer words is one n-gram of all it has; without words the set is empty.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    last = np.flatnonzero(blank & ~np.append(True, blank[:-1]))
    hashed = RangeHashes(data).of(first, last)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.append(0, np.searchsorted(first, np.cumsum(sizes)))
    grams = np.zeros(max(0, hashed.size - words + 1), np.uint64)
    for j in range(words):
        grams = mix64(grams + _STEP) + hashed[j : j + grams.size]
    grams, out = mix64(grams), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashed[a:b]:
                whole = mix64(whole + _STEP) + h
            out.append(mix64(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def vertex_of(grams: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return b"".join(int(mix64(grams ^ _salt(k)).sum(dtype=np.uint64)).to_bytes(8, "big") for k in (3, 5))


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """One lowest hash for each of 64 slots; 0xFFFF in slots without an n-gram."""
    slots = np.full(_SLOTS, _EMPTY, np.uint16)
    mixed = mix64(grams + _salt(7))
    np.minimum.at(slots, (mixed >> np.uint64(58)).astype(np.int64), ((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(_EMPTY)).astype(np.uint16))
    return slots


def chosen(grams: np.ndarray, seeds: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(seed index, key of the longer path) of the n-grams that each seed chooses."""
    line = np.uint64(min(share, 1.0) * (2**64 - 2048))
    ups, keys, step = [], [], max(1, 1_000_000 // grams.size)
    for at in range(0, seeds.size, step):
        own = seeds[at : at + step] | np.uint64(1)
        up, gram = np.nonzero(grams[None, :] * own[:, None] <= line)
        ups.append(up + at)
        keys.append(mix64(grams[gram] ^ mix64(own[up])))
    return np.concatenate(ups), np.concatenate(keys)


def set_rows(shipments: DataFrame, words: int, runs: int, branches: float, depth: int) -> DataFrame:
    """Per row: vertex, set size, sketch, and the keys of its paths by step with the index of the step before."""

    def run(batch: pa.RecordBatch) -> dict:
        vertices, sizes, sketches = [], [], []
        paths: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth)]
        roots = mix64(np.arange(1, runs + 1, dtype=np.uint64) * _STEP)
        for part in _parts(as_bytes(rows_of(batch, "delivery_hub"))):
            for grams in shingle_sets(part, words):
                sizes.append(grams.size)
                vertices.append(vertex_of(grams) if grams.size else None)
                sketches.append(sketch_of(grams).tobytes() if grams.size else None)
                seeds = roots
                for step in range(depth):
                    if grams.size and seeds.size:
                        up, seeds = chosen(grams, seeds, branches / grams.size)
                    else:
                        up, seeds = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                    paths[step].append((up.astype(np.int32), seeds.view(np.int64)))
        return {
            "shipment_id": rows_of(batch, "shipment_id"), "vertex": pa.array(vertices, pa.binary()), "size": pa.array(sizes, pa.int32()),
            "sketch": pa.array(sketches, pa.binary()),
        } | {f"step{i}": _lists(paths[i]) for i in range(depth)}

    steps = ", ".join(f"step{i} array<struct<up: int, key: long>>" for i in range(depth))
    schema = f"shipment_id {key_type(shipments)}, vertex binary, size int, sketch binary, {steps}"
    return map_batches(shipments.select("shipment_id", "delivery_hub"), run, schema)


def _lists(paths: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """One list of (up, key) per text, from flat arrays."""
    offsets = np.append(0, np.cumsum([up.size for up, _ in paths])).astype(np.int32)
    flat = [pa.array(np.concatenate(x)) for x in zip(*paths)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(flat, ["up", "key"]))


def _parts(texts: list[bytes]):
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _PART_BYTES or i + 1 == len(texts):
            yield texts[start : i + 1]
            start, size = i + 1, 0


def bucket_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) found by brute force inside each bucket of ``members`` (key, vertex, size, sketch).

    Pairs whose sizes or sketches rule out ``threshold`` are left; the rest
    link each member to the first one it is joined to, so a bucket of n members
    gives fewer than n links.
    """
    buckets = members.repartition(shuffle_width(members.sparkSession), "key").sortWithinPartitions("key")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            keys = table["key"].to_numpy()
            if not keys.size:
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            held = table.slice(cut)
            if cut:
                yield from _links_of(table.slice(0, cut), threshold)
        if held is not None and held.num_rows:
            yield from _links_of(held, threshold)

    return buckets.mapInArrow(run, "a binary, b binary")


def _links_of(table: pa.Table, threshold: float):
    keys, sizes = table["key"].to_numpy(), table["size"].to_numpy()
    slots = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, _SLOTS)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(np.append(starts, keys.size))
    label = np.arange(keys.size)
    # every row meets the later rows of its bucket; rows are taken in runs of about 50,000 pairs
    later = np.repeat(starts + counts, counts) - np.arange(keys.size) - 1
    pairs, at = [], 0
    while at < keys.size:
        to = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), 50_000)) + at)
        own = later[at:to]
        i = np.repeat(np.arange(at, to), own)
        j = i + 1 + np.arange(i.size) - np.repeat(np.cumsum(own) - own, own)
        near = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
        i, j = i[near], j[near]
        a, b = slots[i], slots[j]
        used = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
        alike = ((a == b) & (a != _EMPTY)).sum(1) >= 0.45 * used
        pairs.append((i[alike], j[alike]))
        at = to
    i, j = (np.concatenate(x) for x in zip(*pairs))
    while i.size:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (before == label).all():
            break
    linked = np.flatnonzero(label != np.arange(keys.size))
    if linked.size:
        vertex = table["vertex"]
        yield pa.RecordBatch.from_pydict({
            "a": vertex.take(pa.array(linked)).combine_chunks(), "b": vertex.take(pa.array(label[linked])).combine_chunks(),
        })


def head_likeness(crowd: DataFrame) -> DataFrame:
    """(key, vertex, head, likeness): each member of a large bucket against the bucket's head, by sketches."""

    def run(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(rows_of(batch, c).to_pylist()), np.uint16).reshape(-1, _SLOTS) for c in ("sketch", "head_sketch"))
        used = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
        return {c: rows_of(batch, c) for c in ("key", "vertex", "head")} | {"likeness": ((a == b) & (a != _EMPTY)).sum(1) / used}

    return map_batches(crowd.select("key", "vertex", "sketch", "head", "head_sketch"), run, "key long, vertex binary, head binary, likeness double")


def candidate_links(vertices: DataFrame, run: Stages, threshold: float, depth: int, bucket: int) -> DataFrame:
    """Links (a, b) between vertices that share a bucket and are not ruled out.

    A bucket of more than ``bucket`` members is split by the next step. From the
    second step on its members are first compared with one of them, the head:
    those that may be near it (``FAR``) are linked to it, and those surely near
    it (``NEAR``) need no further split, as whatever is similar to them may be
    near the head too and is linked to it. So a large group of near copies is
    gathered at once. What is still too large after the last step shares a path of ``depth``
    n-grams and is linked whole; the exact comparison tells its members apart.
    """
    found = left = along = None
    sketches = vertices.select("vertex", "size", "sketch")
    for step in range(depth):
        rows = vertices.select("vertex", F.explode(f"step{step}").alias("p"), *([f"step{step - 1}"] if step else []))
        if step:
            before = F.element_at(f"step{step - 1}", F.col("p.up") + 1).getField("key")
            rows = rows.withColumn("before", before).join(left.withColumnRenamed("key", "before"), along, "left_semi")
        rows = run.save(rows.select("vertex", F.col("p.key").alias("key")), f"step{step}")
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        counts = run.save(counts, f"counts{step}")
        small = rows.join(counts.filter(F.col("n") <= bucket).select("key"), "key")
        links = bucket_links(small.join(sketches, "vertex"), threshold)
        found = links if found is None else found.union(links)
        large = counts.filter(F.col("n") > bucket).select("key")
        if not large.limit(1).count():
            return found
        if not step and depth > 1:
            # shared passages make most of the first large buckets; one more step tells their texts apart
            left, along = large, ["before"]
            continue
        crowd = run.save(rows.join(large, "key").join(sketches.select("vertex", "sketch"), "vertex"), f"crowd{step}")
        heads = crowd.groupBy("key").agg(F.min(F.struct("vertex", "sketch")).alias("h"))
        heads = run.save(heads.select("key", F.col("h.vertex").alias("head"), F.col("h.sketch").alias("head_sketch")), f"top{step}")
        told = run.save(head_likeness(crowd.join(heads, "key")), f"heads{step}")
        found = found.union(told.filter(F.col("likeness") >= FAR).select(F.col("vertex").alias("a"), F.col("head").alias("b")))
        left, along = told.filter(F.col("likeness") < NEAR).select("vertex", "key"), ["vertex", "before"]
    firsts = run.save(left.groupBy("key").agg(F.min("vertex").alias("b")), "firsts")
    return found.union(left.join(firsts, "key").select(F.col("vertex").alias("a"), "b"))


def verified(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """Exact links of ``members`` (grp, vertex, block, blocks, copies, delivery_hub).

    A group of more than one block is compared block by block, each pair of
    blocks in a task of its own. Returns (vertex, links, other) per vertex and
    task: the number of rows it is similar to there, and one vertex it is joined to.
    """
    pairs = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(
        "grp", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "vertex", "copies", "delivery_hub"
    )

    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(as_bytes(table["delivery_hub"]), words)
        names = table["vertex"].to_pylist()
        # a text that shares the id of another is not its vertex's text
        own = {v: i for i, (v, s) in enumerate(zip(names, sets)) if vertex_of(s) == v}
        at = np.array(sorted(own.values(), key=names.__getitem__), np.int64)
        vertex = np.array([names[i] for i in at], object)
        block, copies = table["block"].to_numpy()[at], table["copies"].to_numpy()[at].astype(float)
        cross = table["low"][0].as_py() != table["high"][0].as_py()
        similar = similar_sets([sets[i] for i in at], threshold)
        if cross:
            similar &= block[:, None] != block[None, :]
        label = np.arange(vertex.size)
        while vertex.size:
            low = np.where(similar, label[None, :], vertex.size).min(1)
            low = np.minimum(label, low)
            low = low[low]
            if (low == label).all():
                break
            label = low
        return pa.table({
            "vertex": pa.array(vertex.tolist(), pa.binary()), "links": pa.array((similar @ copies).astype(np.int64)),
            "other": pa.array(vertex[label].tolist(), pa.binary()),
        })

    return pairs.groupBy("grp", "low", "high").applyInArrow(run, "vertex binary, links long, other binary")


def similar_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets have a Jaccard similarity of ``threshold`` or more; not with themselves."""
    sizes = np.array([s.size for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    rows, column = rows[shared], column[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], np.unique(column[order], return_inverse=True)[1]
    both, width = np.zeros((len(sets), len(sets))), 4096
    for start in range(0, int(column[-1]) + 1 if column.size else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        held = np.zeros((len(sets), int(column[b - 1]) - start + 1), np.float32)
        held[rows[a:b], column[a:b] - start] = 1
        both += held @ held.T
    union = sizes[:, None] + sizes[None, :] - both
    similar = both >= threshold * union - 1e-9
    np.fill_diagonal(similar, False)
    return similar


def join_similar(
    shipments: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = 0.999, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """Classes of near-equal texts: Jaccard similarity of word n-gram sets of ``threshold`` or more.

    ``recall`` is the least chance that a pair at the threshold meets in a
    bucket; pairs above it meet more often, and members of one group are all
    compared whichever pair met.

    Returns one row per input row: ``shipment_id``, ``class_id`` (the smallest
    id of its class; classes are joined by links) and ``n_links`` (other rows
    similar to it). Texts with equal sets are similar. A null or empty text, or
    one of blanks alone, is a class of its own without links. Rows that share an
    id are rows of their own. An empty table gives no rows.

    Truck records fit as well: stop lists or lanes as the text.
    """
    spark = shipments.sparkSession
    run = stages(spark, "ngrams")
    rows = run.save(set_rows(shipments, words, runs_for(recall, threshold), BRANCHES, DEPTH), "rows")
    firsts = [F.first(c).alias(c) for c in ("size", "sketch", *(f"step{i}" for i in range(DEPTH)))]
    vertices = rows.filter("vertex IS NOT NULL").groupBy("vertex")
    vertices = run.save(vertices.agg(F.count("*").alias("copies"), F.min("shipment_id").alias("least_id"), *firsts), "vertices")
    links = run.save(candidate_links(vertices, run, threshold, DEPTH, bucket), "links")
    groups = components(links, run, "groups").select(F.col("node").alias("vertex"), F.col("label").alias("grp"))
    blocks = run.save(groups.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    members = groups.join(blocks, "grp").join(vertices.select("vertex", "copies"), "vertex")
    members = members.withColumn("block", F.pmod(F.xxhash64("vertex"), "blocks").cast("int"))
    # one row with the text for each vertex: that of its least id
    named = vertices.select("vertex", F.col("least_id").alias("_id"))
    named = members.join(named, "vertex")
    texts = shipments.select("shipment_id", "delivery_hub").join(named, F.col("shipment_id").eqNullSafe(F.col("_id")))
    exact = run.save(verified(texts, words, threshold), "exact")
    degrees = exact.groupBy("vertex").agg(F.sum("links").alias("links"))
    classes = components(exact.select(F.col("vertex").alias("a"), F.col("other").alias("b")), run, "classes")
    classes = classes.select(F.col("node").alias("vertex"), F.col("label").alias("class"))
    told = vertices.select("vertex", "copies", "least_id").join(degrees, "vertex", "left").join(classes, "vertex", "left")
    told = run.save(told.withColumn("class", F.coalesce("class", "vertex")), "told")
    names = run.save(told.groupBy("class").agg(F.min("least_id").alias("class_id")), "names")
    told = told.join(names, "class").select("vertex", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("shipment_id", "vertex").join(told, "vertex", "left").select(
        "shipment_id", F.coalesce("class_id", "shipment_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
