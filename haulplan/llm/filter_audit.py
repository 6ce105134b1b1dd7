"""How filters on free text overlap: who removes what, in which order.

Every text is judged by all filters at once and becomes a mask of failed ones.
The last filter, exact copies, needs to know every other text. Texts are put
into compressed (radix) tries whose terminals hold the smallest id:

* each batch of rows first builds a trie of its own. A text that is not the
  smallest of its terminal is a copy for certain; only the smallest ones go on, so
  a text that a third of all rows share leaves a batch once;
* the others are ranged by adaptive prefixes of the text, which grow until no
  prefix holds more than a bounded number of bytes, and each range builds its trie.

Counts by mask, at most 32 a part, are all that the orders need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .common import as_bytes, key_type, rows_of, shuffle_width, stages

#: The filters in the order of their bits.
FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")
#: First prefix length in code points; a heavy prefix is lengthened by this factor.
PREFIX = 16
#: Bytes of texts that one prefix, and about one range, may hold.
RANGE_BYTES = 32 << 20
#: Heavy prefixes that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_BATCH_BYTES = 16 << 20
_SYMBOL = re.compile(rb"[#$%&*|]")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Node:
    __slots__ = ("label", "children", "lowest", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.lowest, self.rows = label, None, None, None


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` stand in ``text`` at ``at``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class TextTrie:
    """A compressed trie over bytes: an edge holds as many bytes as no two texts part in."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if it is new."""
        node, at = self.root, 0
        while at < len(text):
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _common(child.label, text, at)
            middle = node.children[text[at]] = Node(child.label[:n])
            child.label = child.label[n:]
            middle.children = {child.label[0]: child}
            node, at = middle, at + n
        return node

    def insert(self, text: bytes, key, row: int) -> None:
        """``row`` ends at its terminal, which keeps the smallest key; a null key is in no order."""
        node = self.terminal(text)
        if node.rows is None:
            node.rows = []
        node.rows.append(row)
        if key is not None and (node.lowest is None or key < node.lowest):
            node.lowest = key

    def terminals(self) -> Iterator[Node]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.rows:
                yield node
            todo.extend((node.children or {}).values())


def own_mask(text: bytes) -> int:
    """Bits of the filters that a text fails by itself: words, distinct words, capitals, symbols."""
    words = text.split()
    n, capitals = len(words), len(text) - len(text.translate(None, _CAPITALS))
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    return (
        (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | (_SYMBOL.search(text) is not None) << 3
    )


def _heavy(texts: DataFrame, run: Stages, most: int) -> list[tuple[int, DataFrame]]:
    """(length, hashes of the prefixes of that length that hold over ``most`` bytes), longer and longer."""
    out, length, left = [], PREFIX, texts
    while True:
        prefix = F.xxhash64(F.substring("text", 1, length))
        sums = left.groupBy(prefix.alias("h")).agg(F.sum(F.octet_length("text").cast("long")).alias("held"), F.max(F.length("text")).alias("longest"))
        sums = run.save(sums.filter((F.col("held") > most) & (F.col("longest") > length)).select("h"), f"heavy_{length}")
        n = sums.count()
        if not n:
            return out
        small = F.broadcast(sums) if n <= MOST_BROADCAST else sums
        out.append((length, small))
        left = left.join(small, prefix == F.col("h"), "left_semi")
        length *= PREFIX


def _deep(texts: DataFrame, heavy: list[tuple[int, DataFrame]]) -> DataFrame:
    """``texts`` with ``head``, their first letters, and ``deep``, the hash of the first prefix that is not heavy."""
    prefix, open_ = F.xxhash64(F.substring("text", 1, PREFIX)), F.lit(True)
    for i, (length, sums) in enumerate(heavy):
        sums = sums.select(F.col("h").alias(f"h{i}"))
        texts = texts.join(sums, F.xxhash64(F.substring("text", 1, length)) == F.col(f"h{i}"), "left")
        open_ = open_ & F.col(f"h{i}").isNotNull()
        prefix = F.when(open_, F.xxhash64(F.substring("text", 1, length * PREFIX))).otherwise(prefix)
    return texts.withColumns({"head": F.substring("text", 1, PREFIX), "deep": prefix}).drop(*[f"h{i}" for i in range(len(heavy))])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own masks; texts stay only where a smaller id may still turn up elsewhere."""
    for whole in batches:
        step = max(1, int(whole.num_rows * _BATCH_BYTES / max(whole.nbytes, 1)))
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            texts, keys = as_bytes(rows_of(batch, "text")), rows_of(batch, "key").to_pylist()
            masks, undecided, trie = [own_mask(t) for t in texts], [False] * len(texts), TextTrie()
            for row, (text, key) in enumerate(zip(texts, keys)):
                trie.insert(text, key, row)
            for node in trie.terminals():
                for row in node.rows:
                    if keys[row] is None:
                        continue
                    if keys[row] == node.lowest:
                        undecided[row] = True
                    else:
                        masks[row] |= _COPY
            kept = pa.array(undecided)
            none = pa.nulls(len(texts), pa.string())
            text = pc.if_else(kept, rows_of(batch, "text").cast(pa.string()), none)
            sizes = pa.array([len(t) if u else 0 for t, u in zip(texts, undecided)], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "key": rows_of(batch, "key"), "part": rows_of(batch, "part"), "mask": pa.array(masks, pa.int32()),
                "head": rows_of(batch, "head"), "deep": rows_of(batch, "deep"), "size": sizes, "text": text,
            })


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one range: rows above the smallest id of their terminal are copies."""
    trie, done, n = TextTrie(), [], 0
    keys: list = []
    for batch in batches:
        own = rows_of(batch, "key").to_pylist()
        for row, (text, key) in enumerate(zip(as_bytes(rows_of(batch, "text")), own), n):
            trie.insert(text, key, row)
        keys += own
        n += len(own)
        done.append(batch.select(["key", "part", "mask"]))
    copies = [0] * n
    for node in trie.terminals():
        for row in node.rows:
            if keys[row] != node.lowest:
                copies[row] = _COPY
    n = 0
    for batch in done:
        more = pa.array(copies[n : n + batch.num_rows], pa.int32())
        n += batch.num_rows
        masks = pc.bit_wise_or(rows_of(batch, "mask"), more)
        yield pa.RecordBatch.from_pydict({"key": rows_of(batch, "key"), "part": rows_of(batch, "part"), "mask": masks})


def failed_filters(shipments: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(shipment_id, part, mask) of every shipment's free text; bit i is set where filter ``FILTERS[i]`` fails.

    Filters on the whole ``delivery_hub`` text: A under 100 words; B under 80 % of
    the words distinct; C over 10 % of the code points A-Z; D any of ``#$%&*|``; E the
    text of a smaller ``shipment_id``. ``part`` is the goods type, null as empty.

    A null text is empty, and equal to empty ones. Rows that repeat the smallest id
    are no copies of each other. A null id is in no order: it is never a copy and makes
    none. An empty table gives no rows; columns of other names are ignored.
    """
    run, key = stages(shipments.sparkSession, "filters"), key_type(shipments)
    texts = shipments.select(
        F.col("shipment_id").alias("key"), F.coalesce("goods_type", F.lit("")).alias("part"), F.coalesce("delivery_hub", F.lit("")).alias("text")
    )
    marked = _deep(texts, _heavy(texts, run, range_bytes))
    fields = f"key {key}, part string, mask int"
    marked = run.save(marked.mapInArrow(_judge, f"{fields}, head string, deep long, size long, text string"), "marked")
    held = marked.agg(F.sum("size")).first()[0] or 0
    ranges = max(shuffle_width(shipments.sparkSession), -(-held // range_bytes))
    open_ = marked.filter("text IS NOT NULL").repartitionByRange(ranges, "head", "deep")
    flagged = open_.select("key", "part", "mask", "text").mapInArrow(_flag, fields)
    sure = marked.filter("text IS NULL").select("key", "part", "mask")
    return flagged.union(sure).withColumnRenamed("key", "shipment_id")


def _orders(patterns: DataFrame) -> DataFrame:
    """Every pattern under every order and step, with the bit of the step's filter and the bits before it."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = patterns.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(wanted) -> Column:
        total = F.lit(0)
        for i, letter in enumerate(FILTERS):
            total = total + F.when(wanted(F.instr("filter_order", letter)), 1 << i).otherwise(0)
        return total

    return rows.withColumns({"bit": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})


def filter_interactions(shipments: DataFrame, labels: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What each filter removes, in all orders of the filters, per goods type.

    ``labels`` holds ``shipment_id``, ``quality`` and ``toxic`` (0/1, null as 0); an id
    labelled more than once counts by its largest values. For the filters see
    ``failed_filters``.

    Returns per ``part``, ``filter_order`` (120) and ``step`` (1 to 5) the shipments
    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed
    earlier), ``unique_fails`` (fail its filter alone), ``good_lost`` and ``toxic_lost``
    (removed by it, labelled so), and ``shapley``: what the filter removes, summed
    over all orders. Zeros included; an empty table gives no rows.
    """
    masks = failed_filters(shipments, range_bytes)
    flags = labels.groupBy(F.col("shipment_id").alias("_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("bad")
    )
    known = masks.join(flags, F.col("shipment_id") == F.col("_id"), "left")
    patterns = known.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0)).cast("long")).alias("good"), F.sum(F.coalesce("bad", F.lit(0)).cast("long")).alias("bad")
    )
    hit, early = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    share = (F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")

    def total(when: Column, what: Column, name: str) -> Column:
        return F.sum(F.when(when, what).otherwise(F.lit(0).cast("long"))).alias(name)

    n = F.col("n")
    return (
        _orders(patterns).groupBy("part", "filter_order", "step")
        .agg(
            total(~hit & ~early, n, "kept"), total(hit & ~early, n, "removed"), total(hit & early, n, "redundant"),
            total(F.col("mask") == F.col("bit"), n, "unique_fails"), total(hit & ~early, F.col("good"), "good_lost"),
            total(hit & ~early, F.col("bad"), "toxic_lost"), total(hit, n * share, "shapley"),
        )
    )
