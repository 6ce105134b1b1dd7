"""First-fit decreasing split of groups over the payload cap.

First-fit places equal weights alike, so a group is solved on its distinct
weights with their counts: bins in equal state form runs, and a run takes a
whole block of equal shipments at once. A tournament tree over the bins' room
finds the first run that still takes a weight in a logarithmic number of steps.

Weights arrive heaviest first as rows of a sorted partition, and pieces leave as
rows, so a group of any number of weights never lies in one row; a task holds
the bins of the group it is at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import spread
from .vehicles import ranked


class RoomTree:
    """Runs of bins in equal state, found by their first bin.

    A run stands at the leaf of its first bin; the leaves of its other bins are
    covered. So a run is split by setting leaves, whatever lies behind it. A
    node holds the largest room below it.
    """

    def __init__(self):
        self.size, self.bins = 64, 0
        self.best = array("q", [-1]) * (2 * self.size)
        self.width = array("q", [0]) * self.size

    def first(self, weight: int) -> int:
        """The first bin with room for ``weight``, or -1."""
        best, at = self.best, 1
        if best[1] < weight:
            return -1
        while at < self.size:
            at *= 2
            if best[at] < weight:
                at += 1
        return at - self.size

    def room(self, at: int) -> int:
        return self.best[at + self.size]

    def put(self, at: int, room: int, width: int) -> None:
        """A run of ``width`` bins at ``at``; bins after the last are new."""
        if at + width > self.size:
            self._grow(at + width)
        self.bins = max(self.bins, at + width)
        self.width[at] = width
        best, node = self.best, at + self.size
        best[node] = room
        node //= 2
        while node:
            a, b = best[2 * node], best[2 * node + 1]
            most = a if a > b else b
            if best[node] == most:
                break
            best[node] = most
            node //= 2

    def _grow(self, bins: int) -> None:
        leaves, size = self.best[self.size :], self.size
        while self.size < bins:
            self.size *= 2
        self.best = array("q", [-1]) * self.size + leaves + array("q", [-1]) * (self.size - size)
        self.width.extend(array("q", [0]) * (self.size - size))
        for node in range(self.size - 1, 0, -1):
            self.best[node] = max(self.best[2 * node], self.best[2 * node + 1])


def place_weight(tree: RoomTree, weight: int, count: int, cap: int) -> Iterator[tuple[int, int, int, int]]:
    """Put ``count`` shipments of one weight into ``tree``.

    Yields pieces (first rank, shipments, first bin, shipments per bin): shipment
    ``rank`` of the weight lies in bin ``first_bin + (rank - first_rank) // per_bin``.
    """
    rank = 0
    while count:
        at = tree.first(weight)
        if at < 0:
            break
        room, width = tree.room(at), tree.width[at]
        per = room // weight
        if count >= per * width:
            full, rest = width, 0
        else:
            full, rest = divmod(count, per)
        if full:
            yield rank, full * per, at, per
        if rest:
            yield rank + full * per, rest, at + full, rest
        rank, count = rank + full * per + rest, count - full * per - rest
        parts = ((room - per * weight, full), (room - rest * weight, 1 if rest else 0), (room, width - full - (1 if rest else 0)))
        for left, n in parts:
            if n:
                tree.put(at, left, n)
                at += n
    if count:
        per = max(cap // weight, 1)
        full, rest = divmod(count, per)
        for n, held in ((full, per), (1 if rest else 0, rest)):
            if n:
                yield rank, n * held, tree.bins, held
                tree.put(tree.bins, max(cap - held * weight, 0), n)
                rank += n * held


def first_fit_runs(sizes, counts, cap: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (weight index, first rank, shipments, first bin, per bin) of one group, weights in descending order."""
    tree = RoomTree()
    return [(c, *piece) for c, (size, n) in enumerate(zip(sizes, counts)) for piece in place_weight(tree, int(size), int(n), cap)]


_PIECE = ("rank", "items", "bin", "per")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the groups of a partition; a group goes on from batch to batch."""
    group, tree = None, None
    for batch in batches:
        rows: list[tuple] = []
        for window, weight, n in zip(*(batch.column(c).to_pylist() for c in ("window_id", "weight_u", "n"))):
            if tree is None or window != group:
                group, tree = window, RoomTree()
            rows.extend((window, weight, *piece) for piece in place_weight(tree, weight, n, K.MAX_PAYLOAD_U))
        if rows:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], batch.column("window_id").type), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, ["window_id", "weight_u", *_PIECE])


def split_payload(over: DataFrame) -> DataFrame:
    """Add ``bin_no`` to the shipments of groups over the payload cap.

    ``over`` holds ``window_id``, ``weight_u``, ``earliest_s`` and
    ``shipment_id``, and may tell the shipments of the group as ``group_n``. Order: weight descending, earliest time, then the id as
    ``ranked`` has it. Ranks come from counts and running offsets, so one
    weight of a very large group is ranked by many tasks.
    """
    keys = ["window_id", "weight_u"]
    classes = over.groupBy(*keys).agg(F.count("*").alias("n"))
    in_order = spread(classes, "window_id").sortWithinPartitions("window_id", F.desc("weight_u"))
    window = over.schema["window_id"].dataType.simpleString()
    pieces = in_order.mapInArrow(_pieces, f"window_id {window}, weight_u long, " + ", ".join(f"`{c}` long" for c in _PIECE))
    placed = ranked(over, keys, "shipment_id", "_rank", ("earliest_s",), "group_n" if "group_n" in over.columns else None).withColumn("_rank", F.col("_rank") - 1)
    hit = (F.col("_rank") >= F.col("rank")) & (F.col("_rank") < F.col("rank") + F.col("items"))
    a, b = placed.alias("a"), pieces.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    bin_no = F.col("bin") + F.floor((F.col("_rank") - F.col("rank")) / F.col("per"))
    return a.join(b, on[0] & on[1] & hit).select(*[F.col(f"a.{c}") for c in over.columns], bin_no.alias("bin_no"))
