"""Loading boxes into a hold: shelves, stacking limits, bulk fallback, convoys.

A truck's boxes come as one row and are bounded by its payload. The helper
below places one box after another; everything around it is Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.measures import pack_volume_cm3, side
from ..session import Stages, spread
from ..sources.fleet import LARGEST, STACKING, STACKING_DEFAULT


def orientations(l: float, w: float, h: float, upright: bool, floor_only: bool, rotate: bool = True):
    """Allowed (length, width, height) of a box.

    Upright goods keep their longest side vertical, floor-only goods lie flat.
    ``rotate=False`` keeps every box as it is given.
    """
    if not rotate:
        return [(l, w, h)]
    every = list(dict.fromkeys([(l, w, h), (l, h, w), (w, l, h), (w, h, l), (h, l, w), (h, w, l)]))
    if upright:
        return [r for r in every if r[2] == max(l, w, h)]
    if floor_only:
        return [min(every, key=lambda r: r[2])]
    return every


@dataclass
class Shelf:
    z: float
    height: float = 0.0
    x: float = 0.0
    y: float = 0.0
    row: float = 0.0  # how far the next row moves in y
    bears: float = float("inf")  # smallest load its boxes allow on top
    heaviest: float = 0.0
    boxes: int = 0


@dataclass
class Hold:
    """The hold of one truck.

    ``strict=True`` is the default geometry: rows advance by box width, a box
    is tested from the shelf floor, only the top shelf may grow, and stacking
    limits hold on every shelf in both directions. ``strict=False`` advances rows by box
    height, tests above the shelf's top and checks stacking on started
    shelves only.
    """

    l: float
    w: float
    h: float
    max_kg: float
    strict: bool = True
    kg: float = 0.0
    volume: float = 0.0
    shelves: list = field(default_factory=list)

    def __post_init__(self):
        self.shelves.append(Shelf(0.0))

    @property
    def capacity(self) -> float:
        return self.l * self.w * self.h

    def _spot(self, shelf: Shelf, l: float, w: float, h: float):
        if l > self.l or w > self.w:
            return None
        if not self.strict:
            low = shelf.z + shelf.height + h <= self.h
        elif shelf is self.shelves[-1]:
            low = shelf.z + h <= self.h
        else:
            low = h <= shelf.height
        if not low:
            return None
        if shelf.x + l <= self.l and shelf.y + w <= self.w:
            return shelf.x, shelf.y
        if shelf.y + shelf.row + w <= self.w:
            return 0.0, shelf.y + shelf.row
        return None

    def _bears(self, shelf: Shelf, kg: float, on_top: float) -> bool:
        """Boxes below carry the new one and, if strict, it carries those above."""
        if any(kg > s.bears for s in self.shelves if s.z < shelf.z and s.boxes):
            return False
        return not self.strict or all(s.heaviest <= on_top for s in self.shelves if s.z > shelf.z)

    def _settle(self, shelf: Shelf, x, y, l, w, h, kg: float, on_top: float):
        depth = w if self.strict else h
        new_row = self.strict and y != shelf.y
        shelf.row = depth if new_row else max(depth, shelf.row if shelf.boxes else 0.0)
        shelf.x, shelf.y = x + l, y
        shelf.height = max(shelf.height, h)
        shelf.bears = min(shelf.bears, on_top)
        shelf.heaviest = max(shelf.heaviest, kg)
        shelf.boxes += 1
        return x, y, shelf.z, l, w, h, False

    def add(self, l, w, h, kg, upright, on_top, rotate: bool = True):
        """Place a box on the lowest shelf that takes it, or load it as bulk.

        Returns (x, y, z, l, w, h, bulk).
        """
        shapes = orientations(l, w, h, upright, on_top == 0.0, rotate)
        self.kg += kg
        for shelf in self.shelves:
            if not self._bears(shelf, kg, on_top):
                continue
            for shape in shapes:
                spot = self._spot(shelf, *shape)
                if spot is not None:
                    self.volume += l * w * h
                    return self._settle(shelf, *spot, *shape, kg, on_top)
        top = max(s.z + s.height for s in self.shelves)
        if top < self.h:
            shelf = Shelf(top)
            self.shelves.append(shelf)
            if not self.strict or self._bears(shelf, kg, on_top):
                for shape in shapes:
                    if self._spot(shelf, *shape) is not None:
                        self.volume += l * w * h
                        return self._settle(shelf, 0.0, 0.0, *shape, kg, on_top)
            if self.strict:
                self.shelves.pop()
        self.volume += min(l * w * h * K.BULK_FACTOR, self.capacity * K.BULK_HOLD_SHARE)
        return 0.0, 0.0, 0.0, min(l, self.l), min(w, self.w), min(h, self.h), True

    @property
    def layers(self) -> int:
        return sum(1 for s in self.shelves if s.boxes)


def load_truck(l, w, h, kg, upright, on_top, hold, strict=True, rotate=True):
    """Load boxes in list order; one placement per box, the hold volume used, layers."""
    space = Hold(*hold, strict=strict)
    placed = [space.add(*box, rotate) for box in zip(l, w, h, kg, upright, on_top)]
    return placed, space.volume, space.layers


PLACEMENT = ("x", "y", "z", "l", "w", "h", "bulk")
_LOAD = T.StructType(
    [T.StructField(f, T.ArrayType(T.DoubleType() if f != "bulk" else T.BooleanType())) for f in PLACEMENT]
    + [T.StructField("used_cm3", T.DoubleType()), T.StructField("layers", T.IntegerType())]
)


def _load_udf(strict: bool, rotate: bool):
    @F.pandas_udf(_LOAD)
    def load(
        l: pd.Series, w: pd.Series, h: pd.Series, kg: pd.Series, upright: pd.Series, on_top: pd.Series, hold: pd.Series
    ) -> pd.DataFrame:
        out = {f: [] for f in (*PLACEMENT, "used_cm3", "layers")}
        for *boxes, size in zip(l, w, h, kg, upright, on_top, hold):
            placed, used, layers = load_truck(*[b.tolist() for b in boxes], size.tolist(), strict, rotate)
            for f, values in zip(PLACEMENT, zip(*placed)):
                out[f].append(values)
            out["used_cm3"].append(used)
            out["layers"].append(layers)
        return pd.DataFrame(out)

    return load


def stacking_case(goods: str, position: int, default) -> str:
    """SQL CASE over the stacking rules: 0 upright, 1 kilograms allowed on top."""
    text = {True: "true", False: "false"}
    lit = lambda v: text[v] if isinstance(v, bool) else f"{v}D"
    cases = " ".join(f"WHEN '{g}' THEN {lit(rule[position])}" for g, rule in STACKING.items())
    return f"CASE {goods} {cases} ELSE {lit(default)} END"


def by_volume(items: str) -> Column:
    """Boxes largest first, with packing sides, weight, goods and stop position."""
    rows = F.transform(
        items,
        lambda x, i: F.struct(
            (-pack_volume_cm3(x["length_cm"], x["width_cm"], x["height_cm"])).alias("neg"),
            (-x["weight_u"]).alias("neg_u"),
            x["shipment_id"].alias("shipment_id"),
            i.alias("stop"),
            side(x["length_cm"], 1).alias("l"), side(x["width_cm"], 1).alias("w"), side(x["height_cm"], 1).alias("h"),
            x["weight_kg"].alias("kg"), x["goods_type"].alias("goods_type"),
        ),
    )
    return F.sort_array(rows)


def _single_box(df: DataFrame, rotate: bool) -> DataFrame:
    """Placement of a truck's only box, as expressions."""
    least, most = "least(_b.l, _b.w, _b.h)", "greatest(_b.l, _b.w, _b.h)"
    flat = {"lwh": f"_b.h = {least}", "lhw": f"_b.h != {least} AND _b.w = {least}", "whl": f"_b.h != {least} AND _b.w != {least}"}

    def shape(a: str, b: str, c: str) -> str:
        """The box turned so, where its goods allow it and the hold takes it."""
        allowed = f"CASE WHEN _upright[0] THEN _b.{c} = {most} WHEN _on_top[0] = 0D THEN {flat.get(a + b + c, 'false')} ELSE true END"
        fits = f"_b.{a} <= hold[0] AND _b.{b} <= hold[1] AND _b.{c} <= hold[2]"
        return f"IF({fits}{f' AND {allowed}' if rotate else ''}, named_struct('l', _b.{a}, 'w', _b.{b}, 'h', _b.{c}), NULL)"

    every = ("lwh", "lhw", "wlh", "whl", "hlw", "hwl") if rotate else ("lwh",)
    df = df.withColumn("_b", F.col("_boxes")[0]).withColumn("_s", F.expr(f"coalesce({', '.join(shape(*p) for p in every)})"))
    cut = lambda f, i: f"coalesce(_s.{f}, least(_b.{f}, hold[{i}]))"
    volume = "_b.l * _b.w * _b.h"
    bulk = f"least({volume} * {K.BULK_FACTOR}D, hold[0] * hold[1] * hold[2] * {K.BULK_HOLD_SHARE}D)"
    return df.withColumns(
        {
            "load": F.expr(
                "array(named_struct('shipment_id', _b.shipment_id, 'stop', _b.stop, 'kg', _b.kg, 'x', 0D, 'y', 0D, 'z', 0D, "
                f"'l', {cut('l', 0)}, 'w', {cut('w', 1)}, 'h', {cut('h', 2)}, 'bulk', _s IS NULL))"
            ),
            "used_cm3": F.expr(f"IF(_s IS NULL, {bulk}, {volume})"),
            "layers": F.expr("IF(_s IS NULL, 0, 1)"),
        }
    ).drop("_b", "_s", *_BOX_COLS)


_BOX_COLS = ("_boxes", "_upright", "_on_top")


def load_plan(trucks: DataFrame, strict: bool = True, rotate: bool = True) -> DataFrame:
    """Add ``load`` (placements by volume order), ``used_cm3`` and ``layers``.

    ``trucks`` has ``items`` and the hold as ``hold`` = [l, w, h, max_kg], and
    may tell the number of its items as ``group_size``. A truck with one box is
    placed by expressions and never reaches Python.
    """
    n = F.col("group_size") if "group_size" in trucks.columns else F.size("items")
    upright = stacking_case("x.goods_type", 0, STACKING_DEFAULT[0])
    on_top = stacking_case("x.goods_type", 1, STACKING_DEFAULT[1])
    def boxed(df: DataFrame) -> DataFrame:
        return df.withColumn("_boxes", by_volume("items")).withColumns(
            {
                "_upright": F.expr(f"transform(_boxes, x -> {upright})"),
                "_on_top": F.expr(f"transform(_boxes, x -> {on_top})"),
            }
        )

    many = boxed(trucks.filter(n > 1)).withColumn(
        "_load",
        _load_udf(strict, rotate)("_boxes.l", "_boxes.w", "_boxes.h", "_boxes.kg", "_upright", "_on_top", "hold"),
    )
    zipped = F.arrays_zip(
        F.col("_boxes.shipment_id").alias("shipment_id"), F.col("_boxes.stop").alias("stop"),
        F.col("_boxes.kg").alias("kg"), *[F.col(f"_load.{f}").alias(f) for f in PLACEMENT],
    )
    many = many.withColumns(
        {"load": zipped, "used_cm3": F.col("_load.used_cm3"), "layers": F.col("_load.layers")}
    ).drop(*_BOX_COLS, "_load")
    return many.unionByName(_single_box(boxed(trucks.filter(n == 1)), rotate))


def axle_balance(loaded: DataFrame) -> DataFrame:
    """Front and rear share by box centre; single shipments are never flagged."""
    front = F.expr("aggregate(load, 0D, (a, b) -> a + IF(b.x + b.l / 2 < hold[0] / 2, b.kg, 0D))")
    return (
        loaded.withColumn("_front", front)
        .withColumn("_rear", F.col("weight_kg") - F.col("_front"))
        .withColumns(
            {
                "axle_balance_ok": (F.size("items") == 1)
                | ((F.col("_front") <= K.AXLE_FRONT_KG) & (F.col("_rear") <= K.AXLE_REAR_KG)),
                "axle_front_pct": F.col("_front") / F.col("weight_kg"),
                "axle_rear_pct": F.col("_rear") / F.col("weight_kg"),
            }
        )
        .drop("_front", "_rear")
    )


class TruckIndex:
    """Open trucks of one demand by weight and volume held, to find the truck a box brings closest to the target.

    Trucks lie in the cells of a grid over (weight, volume). The gap of a box to
    a cell is bounded below from the cell's edges, so only the cells next to the
    optimum are scored, nearest first, until no other cell can do better. A
    truck without room for the demand's lightest box (``least`` kilograms) leaves the grid for
    good; so the size of the search and of the task follows the trucks still open. Up to
    ``FEW`` trucks are scored at once, and the grid is made when there are more.
    """

    GRID = 64
    FEW = 512
    SLACK = 1e-9  # cell bounds and gaps are rounded differently

    def __init__(self, least: float = 0.0, strict: bool = True):
        self.least, self.strict = least, strict
        self.holds: dict[int, Hold] = {}
        self.opened = 0
        self.kg, self.cm3 = np.zeros(64), np.zeros(64)
        self.cell, self.spot = np.full(64, -1), np.zeros(64, np.int64)
        self.members: dict[int, np.ndarray] = {}
        self._count: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        """Trucks by cell of the grid, which is made when it is first asked for."""
        if self._count is None:
            self._count = np.zeros(self.GRID * self.GRID, np.int64)
            edge = np.arange(self.GRID) / self.GRID
            self.low, self.high = edge, np.append(edge[1:], np.inf)  # the last cells are open: bulk may exceed the hold
            for truck in self.holds:
                self._enter(truck, self._cell_of(truck))
        return self._count

    def _cell_of(self, truck: int) -> int:
        at = lambda x: min(int(x * self.GRID), self.GRID - 1)
        return at(self.kg[truck] / LARGEST.max_kg) * self.GRID + at(self.cm3[truck] / LARGEST.hold_cm3)

    def _leave(self, truck: int) -> None:
        cell = self.cell[truck]
        if cell >= 0:
            self.count[cell] -= 1
            last = self.members[cell][self.count[cell]]
            self.members[cell][self.spot[truck]], self.spot[last] = last, self.spot[truck]
            self.cell[truck] = -1

    def _enter(self, truck: int, cell: int) -> None:
        members, n = self.members.setdefault(cell, np.zeros(8, np.int64)), self.count[cell]
        if n == len(members):
            members = self.members[cell] = np.concatenate([members, np.zeros(n, np.int64)])
        members[n] = truck
        self.cell[truck], self.spot[truck] = cell, n
        self.count[cell] += 1

    def open(self) -> int:
        truck, self.opened = self.opened, self.opened + 1
        if truck == len(self.kg):
            self.kg, self.cm3, self.spot = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kg, self.cm3, self.spot))
            self.cell = np.concatenate([self.cell, np.full(truck, -1)])
        self.holds[truck] = Hold(*map(float, (LARGEST.l, LARGEST.w, LARGEST.h, LARGEST.max_kg)), strict=self.strict)
        return truck

    def load(self, truck: int, box, rotate: bool = True) -> None:
        hold = self.holds[truck]
        hold.add(*box, rotate)
        self.kg[truck], self.cm3[truck] = hold.kg, hold.volume
        if hold.kg + self.least > LARGEST.max_kg:
            self._leave(truck)
            del self.holds[truck]
            return
        if self._count is None:
            return
        cell = self._cell_of(truck)
        if cell != self.cell[truck]:
            self._leave(truck)
            self._enter(truck, cell)

    def nearest(self, kg: float, cm3: float) -> int:
        """The truck with payload left that the box brings closest to the target, the first of equals; -1 if none has."""
        share = K.FIT_SCORE_SHARE
        if self.opened <= self.FEW:
            # a truck that has left has no room for any box
            heavy = self.kg[: self.opened] + kg
            gap = share * np.abs(heavy / LARGEST.max_kg - K.LF_TARGET) + share * np.abs(
                (self.cm3[: self.opened] + cm3) / LARGEST.hold_cm3 - K.LF_TARGET
            )
            gap[heavy > LARGEST.max_kg] = np.inf
            first = int(gap.argmin()) if self.opened else -1
            return first if first >= 0 and gap[first] < np.inf else -1
        count = self.count
        apart = lambda off: np.maximum(np.maximum(self.low + off, -(self.high + off)), 0.0)
        by_kg = apart(kg / LARGEST.max_kg - K.LF_TARGET)
        by_kg[self.low + kg / LARGEST.max_kg > 1 + self.SLACK] = np.inf
        bound = (share * (by_kg[:, None] + apart(cm3 / LARGEST.hold_cm3 - K.LF_TARGET))).ravel()
        bound[count == 0] = np.inf
        best, least = -1, np.inf
        while True:
            cell = int(bound.argmin())
            if bound[cell] == np.inf or bound[cell] > least + self.SLACK:
                return best
            bound[cell] = np.inf
            trucks = self.members[cell][: count[cell]]
            heavy = self.kg[trucks] + kg
            gap = share * np.abs(heavy / LARGEST.max_kg - K.LF_TARGET) + share * np.abs(
                (self.cm3[trucks] + cm3) / LARGEST.hold_cm3 - K.LF_TARGET
            )
            gap[heavy > LARGEST.max_kg] = np.inf
            low = gap.min()
            if low < np.inf and low <= least:
                first = int(trucks[gap == low].min())
                best, least = (first if low < least else min(best, first)), low

    def put(self, box, rotate: bool = True) -> int:
        """Load a box (l, w, h, kg, upright, on_top); returns its truck."""
        truck = self.nearest(box[3], box[0] * box[1] * box[2])
        if truck < 0:
            truck = self.open()
        self.load(truck, box, rotate)
        return truck


_SIDES = ("_l", "_w", "_h")


def _pack_demands(keys: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Truck and place in the loading order of every row; a demand goes on from batch to batch."""
        demand, index, place = None, None, 0
        for batch in batches:
            trucks, places = [], []
            names = zip(*(batch.column(k).to_pylist() for k in keys))
            boxes = zip(*(batch.column(c).to_pylist() for c in (*_SIDES, "weight_kg", "_upright", "_on_top")))
            for name, least, box in zip(names, batch.column("_least").to_pylist(), boxes):
                if index is None or name != demand:
                    demand, index, place = name, TruckIndex(least), 0
                trucks.append(index.put(box))
                places.append(place)
                place += 1
            kept = [c for c in batch.schema.names if c not in _CONVOY_COLS]
            arrays = [batch.column(c) for c in kept] + [pa.array(trucks, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "_truck", "_place"])

    return pack


_CONVOY_COLS = (*_SIDES, "_upright", "_on_top", "_least")
_CONVOY_FIELDS = (
    "shipment_id", "weight_kg", "weight_u", "length_cm", "width_cm", "height_cm", "goods_type",
    "pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng",
)


def convoys(shipments: DataFrame, keys: list[str], stages: Stages | None = None) -> DataFrame:
    """Trucks for demands that exceed the largest vehicle, one row per truck.

    ``shipments`` are flat rows with the demand ``keys``. A demand is packed
    whole, at every size, largest box first: each box goes to the truck of the
    largest type that it brings closest to the load-factor target. The best
    truck depends on all boxes so far, so one task packs one demand; its boxes
    stream through as sorted rows, and the task holds the open trucks alone.
    Every shipment travels. Shipments over the largest payload are not loaded
    here (see oversize).
    """
    stages = stages or Stages(shipments.sparkSession)
    volume = pack_volume_cm3("length_cm", "width_cm", "height_cm")
    fits = shipments.filter(F.col("weight_kg") <= LARGEST.max_kg).select(*keys, *_CONVOY_FIELDS).withColumn("_v", volume)
    demand = (
        fits.groupBy(*keys)
        .agg(F.sum("weight_u").alias("_u"), F.sum("_v").alias("_vol"), F.min("weight_kg").alias("_least"))
        .filter((F.col("_u") > K.MAX_PAYLOAD_U) | (F.col("_vol") > LARGEST.hold_cm3))
        .select(*keys, "_least")
    )
    boxes = fits.join(demand, keys).withColumns(
        {
            **{name: side(c, 1).cast("double") for name, c in zip(_SIDES, ("length_cm", "width_cm", "height_cm"))},
            "_upright": F.expr(stacking_case("goods_type", 0, STACKING_DEFAULT[0])),
            "_on_top": F.expr(stacking_case("goods_type", 1, STACKING_DEFAULT[1])),
        }
    )
    queued = spread(boxes, *keys).sortWithinPartitions(*keys, F.desc("_v"), F.desc("weight_u"), "shipment_id", *_SIDES).drop("_v")
    out = T.StructType([f for f in queued.schema if f.name not in _CONVOY_COLS])
    out = out.add("_truck", T.IntegerType()).add("_place", T.LongType())
    placed = stages.save(queued.mapInArrow(_pack_demands(keys), out), "convoys")
    counts = placed.groupBy(*keys).agg((F.max("_truck") + 1).alias("convoy_truck_count"))
    in_order = F.sort_array(F.collect_list(F.struct("_place", F.struct(*_CONVOY_FIELDS).alias("item"))))
    trucks = placed.groupBy(*keys, (F.col("_truck") + 1).alias("convoy_truck_num")).agg(F.transform(in_order, lambda x: x["item"]).alias("items"))
    return trucks.join(counts, keys).select(
        *keys, "convoy_truck_num", "convoy_truck_count",
        "items", F.expr("aggregate(items.weight_kg, 0D, (a, x) -> a + x)").alias("weight_kg"),
    )
