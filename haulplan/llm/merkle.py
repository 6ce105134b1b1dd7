"""Merkle manifest of shipments: one hash tree per part, one root over the parts.

Every level is a table of nodes numbered within their part. A node meets its
siblings in one equijoin on computed indices (the start of its run plus its slot
moved on by an offset, modulo the fan; for a fan of two that is XOR with one).
The row in slot zero then has the whole run and emits the parent. Going down
again, a node's path is its own siblings followed by its parent's path.

The texts are read once, for the leaves; afterwards only digests move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages
from .common import shuffle_width, stages

FAN = 8
#: Fields of a shipment that its leaf covers, in this order.
FIELDS = (
    "shipment_id", "pickup_hub", "goods_type", "delivery_hub", "pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng",
    "weight_kg", "length_cm", "width_cm", "height_cm", "earliest_delivery", "latest_delivery",
)


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes; nodes keep digests as bytes and hash them as hex text."""
    return F.unhex(F.sha2(data, 256))


def hex_of(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf_digest(fields: list[Column]) -> Column:
    """Hash of the fields, each as byte count, colon and value, or ``-`` for null: no two records read alike."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[framed(f) for f in fields]))


def _numbered(nodes: DataFrame, order: list[str], run: Stages, name: str) -> DataFrame:
    """``nodes`` with ``idx`` (from 0) and ``n`` within their part, by ``order``.

    Rows are ranged over the whole table, so a part that holds most of it is
    numbered by many tasks; a range's offset comes from the counts before it.
    """
    ranged = nodes.repartitionByRange(shuffle_width(nodes.sparkSession), "part", *order).withColumn("range", F.spark_partition_id())
    ranged = run.save(ranged, f"{name}_ranged")
    sizes = ranged.groupBy("part", "range").agg(F.count("*").alias("size"))
    whole = Window.partitionBy("part")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("part").alias("_part"), F.col("range").alias("_range"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n"),
    )
    inside = Window.partitionBy("part", "range").orderBy(*order)
    joined = ranged.join(sizes, F.col("part").eqNullSafe(F.col("_part")) & (F.col("range") == F.col("_range")))
    return joined.withColumn("idx", F.col("offset") + F.row_number().over(inside) - 1).select("part", "idx", "n", *nodes.columns[1:])


def _with_siblings(nodes: DataFrame, fan: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Nodes with ``left`` and ``right``: the digests of their run before and after them, joined."""
    own = F.struct(*carry, "digest") if carry else F.struct("digest")
    asks = nodes.select("part", "idx", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("offset"))
    asks = asks.withColumn("sibling", F.col("idx") - F.col("idx") % fan + (F.col("idx") + F.col("offset")) % fan)
    # a row rides with its own fields on one ask only: that of offset zero, itself
    asks = asks.filter("sibling < n").select(
        F.col("part").alias("_part"), F.col("idx").alias("_idx"), "n", F.when(F.col("offset") == 0, F.col("own")).alias("own"), "sibling"
    )
    there = nodes.select("part", "idx", "digest")
    met = asks.join(there, F.col("_part").eqNullSafe(F.col("part")) & (F.col("sibling") == F.col("idx")))
    runs = met.groupBy("_part", "_idx", "n").agg(
        F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list(F.struct("sibling", "digest"))).alias("run")
    )

    def side(keep) -> Column:
        return F.aggregate(F.filter("run", keep), F.expr("X''"), lambda a, x: F.concat(a, x["digest"]))

    return runs.select(
        F.col("_part").alias("part"), F.col("_idx").alias("idx"), "n", "own.*",
        side(lambda x: x["sibling"] < F.col("_idx")).alias("left"), side(lambda x: x["sibling"] > F.col("_idx")).alias("right"),
    )


def _levels(leaves: DataFrame, fan: int, run: Stages, name: str, carry: tuple[str, ...]) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves up, each with siblings; the last node of every part)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, levels = leaves, []
    roots = leaves.filter("n = 1").select("part", "digest")
    while most > 1:
        level = run.save(_with_siblings(nodes.filter("n > 1"), fan, carry if not levels else ()), f"{name}_{len(levels)}")
        levels.append(level)
        nodes = level.filter(F.col("idx") % fan == 0).select(
            "part", (F.col("idx") / fan).cast("long").alias("idx"), F.ceil(F.col("n") / fan).alias("n"),
            digest(hex_of(F.concat("digest", "right"))).alias("digest"),
        )
        roots = roots.union(nodes.filter("n = 1").select("part", "digest"))
        most = -(-most // fan)
    return levels, run.save(roots, f"{name}_roots")


def _paths(levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame | None:
    """The lowest level with ``path``: (left, right) of every step to the root. ``above``: the path of each part's last node."""
    step = F.array(F.struct("left", "right"))
    high = above.select(F.col("part").alias("_part"), F.col("path").alias("_path"), *[c for c in above.columns if c not in ("part", "path")])
    more = high.columns[2:]
    below = None
    for level in reversed(levels):
        same = F.col("part").eqNullSafe(F.col("_part"))
        out = level.filter(F.col("n") <= fan).join(high, same)
        if below is not None:
            parents = below.select(F.col("part").alias("_part"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), *more)
            deep = level.filter(F.col("n") > fan).join(parents, same & ((F.col("idx") / fan).cast("long") == F.col("_idx")))
            out = out.unionByName(deep.drop("_idx"))
        below = out.withColumn("path", F.concat(step, "_path")).drop("_part", "_path")
    return below


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to over the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, s: digest(hex_of(F.concat(s["left"], node, s["right"]))))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level from the leaf, left to right."""
    return digest(hex_of(F.aggregate(path, F.expr("X''"), lambda a, s: F.concat(a, s["left"], s["right"]))))


def manifest(
    shipments: DataFrame, key: str = "shipment_id", part: str = "goods_type", fields: tuple[str, ...] = FIELDS,
    received: dict[str, Column] | None = None, fan: int = FAN,
) -> DataFrame:
    """Seal a table of shipments under one root, and check received records against it.

    A shipment's leaf hashes its ``fields``. Per ``part`` (one goods type by
    default), leaves ascend by ``key``; every ``fan`` consecutive nodes become their
    hash until one is left, the part's ``subroot``. Subroots, ordered by part, give
    the ``root`` the same way. ``received`` maps field names to what arrived in
    their place; the leaf of the received record is folded up over the original
    siblings, and ``verified`` tells whether it still leads to the root.

    Returns per shipment: the key and part columns as ``key`` and ``part``, ``leaf``,
    ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (lowercase hex), ``path``
    (array of (left, right), the siblings' digests joined) and ``verified``.

    Null fields hash as ``-``; empty and very long values are hashed whole. A null
    part is a part of its own, before all others; null keys come first. Equal keys
    are ordered by their digests and equal rows are leaves of their own. Other
    columns are ignored, whatever their names. An empty table has no root and gives
    no rows.
    """
    run = stages(shipments.sparkSession, "merkle")
    own = leaf_digest([F.col(f) for f in fields])
    got = leaf_digest([(received or {}).get(f, F.col(f)) for f in fields]) if received else own
    leaves = shipments.select(
        F.col(part).alias("part"), F.col(key).alias("key"), own.alias("digest"), got.alias("received"),
        # parts equal rows, which may be many, over ranges; any order of theirs gives the same tree
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = run.save(leaves, "leaves")
    leaves = run.save(_numbered(leaves, ["key", "digest", "received", "tie"], run, "leaves").drop("tie"), "numbered")
    levels, subroots = _levels(leaves, fan, run, "part", ("key", "received"))
    seats = subroots.select(F.lit(0).alias("part"), F.col("part").alias("name"), "digest")
    seats = run.save(_numbered(seats, ["name"], run, "seats"), "seats")
    tops, roots = _levels(seats, fan, run, "top", ("name",))
    root = roots.first()
    start = F.array().cast("array<struct<left: binary, right: binary>>")
    if tops:
        all_up = _paths(tops, roots.select("part", start.alias("path")), fan)
    else:
        all_up = seats.withColumn("path", start)
    above = all_up.select(F.col("name").alias("part"), "path", F.col("digest").alias("subroot"))
    single = leaves.filter("n = 1").select(F.col("part").alias("p"), "key", "digest", "received")
    single = single.join(above, F.col("p").eqNullSafe(F.col("part"))).drop("p")
    columns = ["part", "key", "digest", "received", "path", "subroot"]
    deep = _paths(levels, above, fan)
    full = single.select(columns) if deep is None else single.select(columns).union(deep.select(columns))
    top = F.unhex(F.lit(bytes(root["digest"]).hex() if root else None).cast("string"))
    folded = fold(F.col("path"), F.col("received"))
    return full.select(
        "key", "part", hex_of(F.col("digest")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(top).alias("root"),
        hex_of(proof_digest(F.col("path"))).alias("proof_sha256"), hex_of(folded).alias("folded_root"), "path", (folded == top).alias("verified"),
    )
