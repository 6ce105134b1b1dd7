import hashlib
import zlib
from collections import defaultdict
from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F

from haulplan.llm import filter_audit, merkle

LABELS = "shipment_id long, quality int, toxic int, text string"


def failed(text, copy):
    words = text.split()
    caps = sum("A" <= c <= "Z" for c in text)
    tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * caps > 10 * len(text), any(c in "#$%&*|" for c in text), copy)
    return {f for f, t in zip("ABCDE", tests) if t}


def plain_audit(rows, labels):
    """Every order walked document by document."""
    good, bad = {i for i, q, _, _ in labels if q == 1} - {None}, {i for i, _, t, _ in labels if t == 1} - {None}
    docs = []
    for i, text, part in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, _ in rows)
        docs.append((i, part or "", failed(text or "", copy)))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine, shapley = [d for d in docs if d[1] == part], defaultdict(int)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                shapley[f] += len(gone)
                hit = sum(f in d[2] for d in mine)
                out[part, "".join(order), step] = [
                    len(left), len(gone), hit - len(gone), sum(d[2] == {f} for d in mine), sum(d[0] in good for d in gone), sum(d[0] in bad for d in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit(rows, labels, range_bytes=filter_audit.RANGE_BYTES):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in filter_audit.filter_interactions(rows, labels, range_bytes).collect()}


def test_interactions_equal_a_plain_walk(spark, make, odd_rows):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [*odd_rows, (20, long), (21, long), (22, long.upper()), (23, long + " #"), (24, ("same words " * 80)), (24, long), (3, long)]
    labels = [(20, 1, 0, "x"), (20, None, 1, "x"), (21, 1, 0, None), (22, 0, 1, "x"), (99, 1, 1, "x"), (None, 1, 1, "x"), (24, 1, None, "x")]
    frame = make(rows)
    full = [(r.shipment_id, r.delivery_hub, r.goods_type) for r in frame.collect()]
    want = plain_audit(full, labels)
    for parts, size in ((1, 1 << 25), (5, 300)):  # many small ranges split heavy prefixes over several rungs
        assert audit(frame.repartition(parts), spark.createDataFrame(labels, LABELS), size) == want


def test_no_shipments_no_parts(spark, make):
    assert filter_audit.filter_interactions(make([]), spark.createDataFrame([], LABELS)).count() == 0


def test_a_trie_keeps_whole_texts_apart():
    trie = filter_audit.TextTrie()
    texts = [b"", b"abc", b"abcd", b"abX", b"abc", b"b", "größe".encode(), "größer".encode(), b"x" * 50_000, b"x" * 49_999 + b"y", b""]
    for row, text in enumerate(texts):
        trie.insert(text, -row, row)
    found = sorted(sorted(n.rows) for n in trie.terminals())
    assert found == [[0, 10], [1, 4], [2], [3], [5], [6], [7], [8], [9]]
    assert all(n.lowest == -max(n.rows) for n in trie.terminals())


def test_a_prefix_that_holds_a_third_of_all_bytes_is_lengthened(spark):
    texts = [(i, "the same long beginning of a form " * 3 + f"{i % 40}", "a") for i in range(400)] + [(i, f"{i} other", "a") for i in range(400, 900)]
    rows = spark.createDataFrame(texts, "shipment_id long, delivery_hub string, goods_type string")
    run = filter_audit.stages(spark, "prefixes")
    heavy = filter_audit._heavy(rows.withColumnRenamed("delivery_hub", "text"), run, 8_000)
    assert [length for length, _ in heavy] == [16] and heavy[0][1].count() == 1
    masks = filter_audit.failed_filters(rows, 8_000)
    assert masks.filter(F.col("mask").bitwiseAND(16) != 0).count() == 360


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan):
    """(root, siblings to the left and right per level of every leaf)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, a in zip(paths, at):
            run = nodes[a // fan * fan : a // fan * fan + fan]
            p.append(("".join(run[: a % fan]), "".join(run[a % fan + 1 :])))
        nodes, at = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)], [a // fan for a in at]
    return nodes[0], paths


def plain_manifest(rows, fan):
    """rows: (key, part, leaf, received leaf)."""
    parts = sorted({r[1] for r in rows}, key=lambda p: (p is not None, (p or "").encode()))
    mine = {p: sorted((r for r in rows if r[1] == p), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(r[2]))) for p in parts}
    trees = {p: climb([r[2] for r in mine[p]], fan) for p in parts}
    root, above = climb([trees[p][0] for p in parts], fan)
    out = []
    for p, top in zip(parts, above):
        for (key, _, leaf, got), path in zip(mine[p], trees[p][1]):
            node = got
            for left, right in path + top:
                node = H(left, node, right)
            out.append((key, p, leaf, trees[p][0], root, H(*(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def sealed(frame):
    names = ("key", "part", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_the_manifest_equals_plain_trees(spark, make, odd_rows):
    fields = ("shipment_id", "goods_type", "delivery_hub")
    frame = make(odd_rows)
    lower = F.when(F.crc32(F.col("shipment_id").cast("string")) % 3 == 0, F.lower("delivery_hub")).otherwise(F.col("delivery_hub"))
    rows = []
    for r in frame.collect():
        text = r.delivery_hub
        if r.shipment_id is not None and text is not None and zlib.crc32(str(r.shipment_id).encode()) % 3 == 0:
            text = text.lower()
        rows.append((r.shipment_id, r.goods_type, leaf_of((r.shipment_id, r.goods_type, r.delivery_hub)), leaf_of((r.shipment_id, r.goods_type, text))))
    for fan in (2, 3, 8):
        assert sealed(merkle.manifest(frame.repartition(3), fields=fields, received={"delivery_hub": lower}, fan=fan)) == plain_manifest(rows, fan)


def test_many_goods_types_and_one_that_holds_most(spark):
    rows = [(f"S{i:04d}", "bulk" if i % 3 else f"type {i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "shipment_id string, goods_type string")
    leaves = [(key, part, leaf_of((key, part)), leaf_of((key, part))) for key, part in rows]
    want = plain_manifest([(int(k[1:]), p, a, b) for k, p, a, b in leaves], 8)
    got = sealed(merkle.manifest(frame.withColumn("part", F.lit(1)).withColumn("idx", F.lit(2)), fields=("shipment_id", "goods_type")))
    assert sorted((int(k[1:]), *r) for k, *r in got) == sorted(want)
    assert all(r[-1] for r in got)


def test_shipments_are_sealed_by_their_own_fields(spark):
    """A changed weight or a moved delivery shows; an untouched record verifies."""
    columns = {f: ["a", "b", "c"] for f in ("pickup_hub", "delivery_hub", "earliest_delivery", "latest_delivery")}
    numbers = {f: [1.5, 2.25, 3.0] for f in ("pickup_lat", "pickup_lng", "delivery_lat", "delivery_lng", "weight_kg")}
    sizes = {f: [10, 20, 30] for f in ("length_cm", "width_cm", "height_cm")}
    frame = spark.createDataFrame(pd.DataFrame({"shipment_id": ["S1", "S2", "S3"], "goods_type": ["x", "x", "y"], **columns, **numbers, **sizes}))
    assert all(r[-1] for r in sealed(merkle.manifest(frame)))
    changed = merkle.manifest(frame, received={"weight_kg": F.when(F.col("shipment_id") == "S2", 9.0).otherwise(F.col("weight_kg"))})
    assert {r[0]: r[-1] for r in sealed(changed)} == {"S1": True, "S2": False, "S3": True}


def test_one_shipment_and_none(spark, make):
    one = sealed(merkle.manifest(make([(5, "x")]), fields=("shipment_id", "delivery_hub")))
    leaf = leaf_of((5, "x"))
    assert one == [(5, None, leaf, leaf, leaf, H(), leaf, True)]
    assert sealed(merkle.manifest(make([]), fields=("shipment_id",))) == []
