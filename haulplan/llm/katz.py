"""Katz backoff scores of free text, from Good-Turing discounted n-gram counts.

Texts are encoded in batches of bounded size; a batch names an n-gram by a 64-bit
hash of its words. The model lives in two tables partitioned by order, and within
an order by ranges of the hash (shards of bounded size): discounted counts, and
per history its denominator and backoff weight. Batches and shards trade blocks:

* a batch asks each shard about its distinct n-grams, with their training counts;
  the shard adds them up and answers the totals. An n-gram crosses once per batch,
  so no shard is hot however common a word is;
* order by order, the batch that owns an n-gram (the first to train on it) adds its
  lower-order probability to the history's sums, and the histories' shards answer
  with weights that make every history's probabilities sum to one;
* with all answers a batch evaluates the recursion for every token at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .common import as_bytes, key_type, map_batches, mix64, rows_of, shuffle_width, stages

#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Text bytes of a batch and tokens of a shard: both bound what a task holds.
BATCH_BYTES = 8 << 20
SHARD_TOKENS = 16_000_000
_SPREAD_TOKENS = 50_000
_BEGIN, _END = b" begin", b" end"  # no word holds a blank
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE = -1  # in place of a batch: a row of the model

_ASK = "`order` int, batch long, shard int, keys binary, counts binary"
_COUNTED = "batch long, shard int, keys binary, counts binary, own binary, sizes array<long>, `order` int"
_SUMS = "`order` int, batch long, shard int, keys binary, total binary, saved binary, lower binary"
_WEIGHED = "batch long, shard int, keys binary, denominator binary, backoff binary, `order` int"


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: the empty high bytes of small numbers lie together and come to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, so that sorted keys are sorted by shard."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    at = np.searchsorted(_shard_of(keys, shards), np.arange(shards + 1))
    for shard in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield shard, slice(at[shard], at[shard + 1])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for whole in batches:
        sizes, first, size = pc.binary_length(rows_of(whole, "delivery_hub")).fill_null(0).to_pylist(), 0, 0
        for i, more in enumerate(sizes):
            size += more
            if size < BATCH_BYTES and i + 1 < len(sizes):
                continue
            names, stream, lengths = _Names({_BEGIN: 0, _END: 1}), [], []
            part = whole.slice(first, i + 1 - first)
            for own in as_bytes(rows_of(part, "delivery_hub")):
                words = own.lower().split()
                stream.append(0)
                stream.extend(map(names.__getitem__, words))
                stream.append(1)
                lengths.append(len(words) + 2)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
            ids, train = rows_of(part, "shipment_id"), ~rows_of(part, "held_out").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_pydict({
                "batch": pa.array([(TaskContext.get().partitionId() << 24) + n], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "train": pa.array([train.tobytes()]), "lengths": pa.array([np.array(lengths, np.int32).tobytes()]),
                "words": pa.array([hashes.tobytes()]), "tokens": pa.array([_pack(np.array(stream, np.uint32))]),
                "n_tokens": pa.array([len(stream)], pa.int64()),
            })
            n, first, size = n + 1, i + 1, 0


class _Batch:
    """The n-grams of an encoded batch: per order their places, distinct keys, and which key stands where."""

    def __init__(self, row: dict, order: int):
        self.ids, self.id = row["ids"], row["batch"]
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.train = np.frombuffer(row["train"], bool)
        words = np.frombuffer(row["words"], np.uint64)[_unpack(row["tokens"], np.uint32)]
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.place = np.arange(words.size, dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.lengths)
        self.learnt = np.repeat(self.train, self.lengths)
        self._keys = [words]
        for _ in range(order - 1):
            longer = words.copy()
            longer[1:] = mix64(self._keys[-1][:-1] * _STEP + words[1:])
            self._keys.append(longer)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the last token, distinct keys ascending, index of the key per place); the begin mark is only a history."""
        at = np.flatnonzero(self.place >= max(k - 1, 1))
        return at, *np.unique(self._keys[k - 1][at], return_inverse=True)

    def histories(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.place >= max(k - 1, 1))
        return np.unique(self._keys[k - 2][at - 1], return_inverse=True)


def _ask(order: int, shards: int):
    def run(batch: pa.RecordBatch) -> dict:
        out = {"order": [], "batch": [], "shard": [], "keys": [], "counts": []}
        for row in batch.to_pylist():
            own = _Batch(row, order)
            for k in range(1, order + 1):
                at, keys, which = own.grams(k)
                counts = np.bincount(which[own.learnt[at]], minlength=keys.size).astype(np.uint32)
                for shard, part in _slices(keys, shards):
                    for name, value in zip(out, (k, own.id, shard, _pack_keys(keys[part]), _pack(counts[part]))):
                        out[name].append(value)
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return {name: pa.array(values, t) for (name, values), t in zip(out.items(), types)}

    return run


def _blocks(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """Blocks by batch, their keys joined, and the order and group starts that sort equal keys together."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    keys = [_unpack_keys(r["keys"]) for r in rows]
    sizes = np.array([k.size for k in keys])
    flat = np.concatenate(keys)
    by_key = np.argsort(flat, kind="stable")  # within a key, blocks ascend
    flat = flat[by_key]
    fresh = np.ones(flat.size, bool)
    fresh[1:] = flat[1:] != flat[:-1]
    return rows, sizes, by_key, fresh


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.replace("`", "").split() for f in schema.split(", ")]
    return pa.table({name: pa.array(list(values), types[t]) for (name, t), values in zip(fields, zip(*rows))})


def _count(table: pa.Table) -> pa.Table:
    """One shard of one order: the sums of its keys to every block, and the shard's part of the model."""
    rows, sizes, by_key, fresh = _blocks(table)
    counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)[by_key]
    group, firsts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    totals = np.add.reduceat(counts, firsts)
    place = np.where(counts > 0, np.arange(counts.size), counts.size)
    own = np.zeros(counts.size, bool)
    first = np.minimum.reduceat(place, firsts)
    own[first[first < counts.size]] = True
    back = np.empty(counts.size, np.int64)
    back[by_key] = np.arange(counts.size)
    ends = np.cumsum(sizes)
    out = []
    for row, end, size in zip(rows, ends, sizes):
        at = back[end - size : end]
        out.append((row["batch"], row["shard"], None, _pack(totals[group[at]]), _pack(own[at].view(np.uint8)), None, row["order"]))
    known = totals > 0
    keys = np.concatenate([_unpack_keys(r["keys"]) for r in rows])[by_key][fresh][known]
    met = np.bincount(np.minimum(totals[known], DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
    stats = [int(totals.sum()), int(known.sum()), *met.tolist()]
    out.append((_TABLE, rows[0]["shard"], _pack_keys(keys), _pack(totals[known]), None, stats, rows[0]["order"]))
    return _table(out, _COUNTED)


@dataclass(frozen=True)
class Discounts:
    """Of one order: tokens, distinct n-grams, and the share of its count that an n-gram keeps."""

    tokens: int
    distinct: int
    kept: tuple[float, ...]

    def numerator(self, counts: np.ndarray) -> np.ndarray:
        kept = np.append(np.array((1.0, *self.kept)), 1.0)
        return counts * kept[np.minimum(counts, len(self.kept) + 1)]


def good_turing(tokens: int, distinct: int, met: list[int]) -> Discounts:
    """``met[r - 1]`` n-grams were seen r times. The largest range of counts whose discounts all lie between 0 and 1 is discounted."""
    for most in range(DISCOUNTED, 0, -1):
        if not all(met[: most + 1]):
            continue
        beyond = (most + 1) * met[most] / met[0]
        kept = [((r + 1) * met[r] / (r * met[r - 1]) - beyond) / (1 - beyond) if beyond < 1 else -1 for r in range(1, most + 1)]
        if all(0 < x < 1 for x in kept):
            return Discounts(tokens, distinct, tuple(kept))
    return Discounts(tokens, distinct, ())


def _unigram(d: Discounts, met: np.ndarray) -> tuple[float, float]:
    """(denominator, probability of an unknown word)."""
    saved = sum(met[r] * (r + 1) * (1 - k) for r, k in enumerate(d.kept))
    over = d.tokens if saved > 0 else d.tokens + 1
    return float(over), (saved if saved > 0 else 1.0) / over


class _Answers:
    """Blocks that the shards sent a batch, joined to whole columns per order."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted((r for r in rows), key=lambda r: r["shard"])

    def of(self, order: int, name: str, kind: type) -> np.ndarray:
        parts = [_unpack(r[name], kind) for r in self.rows if r["order"] == order and r.get(name) is not None]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    def owned(self, order: int) -> np.ndarray:
        return self.of(order, "own", np.uint8).astype(bool)


def _log10(x) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


def _probabilities(own: _Batch, answers: _Answers, upto: int, model: list[Discounts], start: tuple[float, float]) -> Iterator[tuple]:
    """Order by order: (places, key per place, counts per key, log10 probability of every token by that order)."""
    score = np.zeros(own.place.size)
    for k in range(1, upto + 1):
        at, keys, which = own.grams(k)
        counts = answers.of(k, "counts", np.int64)
        direct = _log10(model[k - 1].numerator(counts))
        if k == 1:
            score[at] = np.where(counts > 0, direct - np.log10(start[0]), np.log10(start[1]))[which]
        else:
            _, hist = own.histories(k)
            over, backoff = _log10(answers.of(k, "denominator", np.int64)), answers.of(k, "backoff", np.float64)
            score[at] = np.where(counts[which] > 0, direct[which] - over[hist], backoff[hist] + score[at])
        yield at, which, counts, score


def _add_up(k: int, shards: int, model: list[Discounts], start: tuple[float, float]):
    """Per history of order ``k``, the sums over the n-grams that this batch owns."""

    def run(encoded: pa.Table, sent: pa.Table) -> pa.Table:
        out = []
        for row in encoded.to_pylist():
            own, answers = _Batch(row, k), _Answers(sent.to_pylist())
            *_, (_, _, _, lower) = _probabilities(own, answers, k - 1, model, start)
            at, keys, which = own.grams(k)
            histories, hist = own.histories(k)
            first = np.full(keys.size, -1)
            first[which[::-1]] = np.arange(which.size)[::-1]  # one place per distinct n-gram
            mine = first[answers.owned(k)]
            counts = answers.of(k, "counts", np.int64)[which[mine]]
            total, saved, low = (
                np.bincount(hist[mine], weights=w, minlength=histories.size)
                for w in (counts, counts - model[k - 1].numerator(counts), 10.0 ** lower[at[mine]])
            )
            sums = (total.astype(np.uint32), saved, low)
            for shard, part in _slices(histories, shards):
                out.append((k, own.id, shard, _pack_keys(histories[part]), *[_pack(s[part]) for s in sums]))
        return _table(out, _SUMS) if out else _table([(0, 0, 0, b"", b"", b"", b"")], _SUMS).slice(0, 0)

    return run


def _weigh(table: pa.Table) -> pa.Table:
    """One shard of histories: denominator and log10 of the backoff weight to every block, and to the model."""
    rows, sizes, by_key, fresh = _blocks(table)
    group, firsts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    total, saved, lower = (
        np.add.reduceat(np.concatenate([_unpack(r[c], t) for r in rows]).astype(np.float64)[by_key], firsts)
        for c, t in (("total", np.uint32), ("saved", np.float64), ("lower", np.float64))
    )
    spare = saved <= total * 1e-12  # nothing was discounted: one count is put by
    seen = total > 0
    over = np.where(seen, total + spare, 1)
    left = np.where(seen, np.where(spare, 1.0, saved) / over, 1.0)
    backoff = _log10(left / np.where(seen, np.maximum(1 - lower, 1e-12), 1.0))
    over = over.astype(np.int64)
    back = np.empty(by_key.size, np.int64)
    back[by_key] = np.arange(by_key.size)
    out = []
    for row, end, size in zip(rows, np.cumsum(sizes), sizes):
        at = group[back[end - size : end]]
        out.append((row["batch"], row["shard"], None, _pack(over[at]), _pack(backoff[at]), row["order"]))
    keys = np.concatenate([_unpack_keys(r["keys"]) for r in rows])[by_key][fresh][seen]
    out.append((_TABLE, rows[0]["shard"], _pack_keys(keys), _pack(over[seen]), _pack(backoff[seen]), rows[0]["order"]))
    return _table(out, _WEIGHED)


def _score(order: int, model: list[Discounts], start: tuple[float, float], key: pa.DataType):
    def run(encoded: pa.Table, sent: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]
        for row in encoded.to_pylist():
            own, answers = _Batch(row, order), _Answers(sent.to_pylist())
            base, known = np.zeros(own.place.size), np.zeros(own.place.size)
            for k, (at, which, counts, score) in enumerate(_probabilities(own, answers, order, model, start), 1):
                if k == 1:
                    base[at] = np.log10((counts + 0.5) / (model[0].tokens + 0.5 * (model[0].distinct + 1)))[which]
                    known[at] = (counts > 0)[which]
            sums = [np.add.reduceat(x, own.starts) for x in (known, base, score)]
            n = len(own.ids)
            rows = (own.ids, ~own.train, own.lengths - 1, sums[0].astype(np.int64), np.full(n, model[0].tokens), sums[1], sums[2])
            for column, values in zip(columns, rows):
                column.extend(values.tolist() if isinstance(values, np.ndarray) else values)
        names = ("shipment_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        types = (key, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, t, c in zip(names, types, columns)})

    return run


@dataclass(frozen=True)
class KatzModel:
    """``counts`` (order, shard, keys, counts) and ``weights`` (order, shard, keys, denominator, backoff), one row a shard."""

    counts: DataFrame
    weights: DataFrame | None
    discounts: tuple[Discounts, ...]
    unknown: float

    def rows(self, table: DataFrame, *columns: tuple[str, type]) -> DataFrame:
        """A table unpacked: one row per n-gram or history, ``key`` and the named columns."""

        def run(batch: pa.RecordBatch) -> dict:
            parts = [[r["order"], _unpack_keys(r["keys"]), *[_unpack(r[c], t) for c, t in columns]] for r in batch.to_pylist()]
            flat = [np.concatenate([p[i] for p in parts]) for i in range(1, 2 + len(columns))]
            orders = np.concatenate([np.full(p[1].size, p[0], np.int32) for p in parts])
            return {"order": orders, "key": flat[0].view(np.int64)} | {c: f.astype(np.float64) for (c, _), f in zip(columns, flat[1:])}

        return map_batches(table, run, "`order` int, key long, " + ", ".join(f"{c} double" for c, _ in columns))


def _partitioned(run: Stages, df: DataFrame, name: str) -> DataFrame:
    path = f"{run.root}/{name}"
    df.write.mode("overwrite").partitionBy("order").parquet(path)
    run.release()
    return run.spark.read.schema(df.schema).parquet(path)


def fit_and_score(shipments: DataFrame, held_out: Column | None = None, order: int = 2) -> tuple[DataFrame, KatzModel]:
    """Score every shipment's free text by a Katz model of the texts that are not held out.

    Tokens of the whole ``delivery_hub``: A-Z lower-cased, runs without blanks, then
    one end mark. Unknown words share what discounting frees among the words; an
    n-gram that training lacks backs off to the next shorter one. ``held_out`` is a
    condition on the shipments' columns (null counts as false).

    Returns (scores, model). Scores, one row per shipment: ``shipment_id``,
    ``held_out``, ``n_tokens``, ``n_known`` (tokens training has), ``train_tokens``,
    ``base_score`` (log10, add-half unigrams) and ``score`` (log10 probability).

    Null and empty texts are an end mark. Rows that share an id are texts of their
    own. Without training texts every token is unknown and has probability one.
    An empty table gives no rows; other columns are ignored.
    """
    if order < 1:
        raise ValueError("an n-gram has at least one word")
    spark, key = shipments.sparkSession, key_type(shipments)
    run = stages(spark, "katz")
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    texts = shipments.select("shipment_id", "delivery_hub", flag.alias("held_out"))
    schema = f"batch long, ids array<{key}>, train binary, lengths binary, words binary, tokens binary, n_tokens long"
    encoded = run.save(texts.mapInArrow(_encode, schema), "encoded")
    tokens = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(-(-tokens // SHARD_TOKENS), min(shuffle_width(spark), -(-tokens // _SPREAD_TOKENS)), 1)
    batches = encoded.drop("n_tokens")
    parts = max(shuffle_width(spark), shards)

    asked = map_batches(batches, _ask(order, shards), _ASK)
    counted = _partitioned(run, asked.repartition(parts, "order", "shard").groupBy("order", "shard").applyInArrow(_count, _COUNTED), "counts")
    in_table = counted.filter(F.col("batch") == _TABLE)
    stats = {r["order"]: r["s"] for r in in_table.groupBy("order").agg(
        F.array(*[F.sum(F.col("sizes")[i]) for i in range(DISCOUNTED + 3)]).alias("s")).collect()}
    none = [0] * (DISCOUNTED + 3)
    model = [good_turing(s[0], s[1], s[2:]) for s in (stats.get(k, none) for k in range(1, order + 1))]
    start = _unigram(model[0], np.array(stats.get(1, none)[2:], float))

    empty = F.lit(None).cast("binary")
    answers = counted.filter(F.col("batch") != _TABLE).select("order", "batch", "shard", "counts", "own", empty.alias("denominator"), empty.alias("backoff"))
    weights = None

    def met(step, out: str) -> DataFrame:
        sides = [side.repartition(parts, "batch").groupBy("batch") for side in (batches, answers)]
        return sides[0].cogroup(sides[1]).applyInArrow(step, out)

    for k in range(2, order + 1):
        sums = met(_add_up(k, shards, model, start), _SUMS)
        weighed = _partitioned(run, sums.repartition(parts, "order", "shard").groupBy("order", "shard").applyInArrow(_weigh, _WEIGHED), f"weights{k}")
        told = weighed.filter(F.col("batch") != _TABLE)
        answers = answers.union(told.select("order", "batch", "shard", empty, empty, "denominator", "backoff"))
        own = weighed.filter(F.col("batch") == _TABLE).select("order", "shard", "keys", "denominator", "backoff")
        weights = own if weights is None else weights.union(own)

    fields = f"shipment_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = pa.string() if key == "string" else pa.int64()
    scores = met(_score(order, model, start, arrow), fields)
    return scores, KatzModel(in_table.select("order", "shard", "keys", "counts"), weights, tuple(model), start[1])


def score_texts(shipments: DataFrame, held_out: Column | None = None, order: int = 2) -> DataFrame:
    """The scores of ``fit_and_score``."""
    return fit_and_score(shipments, held_out, order)[0]
