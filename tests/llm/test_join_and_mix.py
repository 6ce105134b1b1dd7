"""The similarity join, the mix and the pipeline."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulplan.llm import mixing, ngram_join


def plain_classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    links, parent = collections.Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return collections.Counter((rows[i][0], least.get(root(i)), links[i]) for i in range(len(rows)))


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"new{rng.integers(1000)}"
    return " ".join(out)


@pytest.mark.parametrize(("bucket", "block"), [(100, 1024), (4, 16)])
def test_join_matches_the_plain_version(make, odd_rows, bucket, block):
    rng = np.random.default_rng(2)
    rows = [r for r in odd_rows if r[0] != 11]
    passage = [f"p{i}" for i in range(40)]
    for group in range(4):
        base = [f"g{group}w{rng.integers(500)}" for _ in range(200)]
        rows += [(100 * (group + 1) + i, edited(rng, base, int(rng.integers(0, 6)))) for i in range(40 if group == 0 else 8)]
    rows += [(1000 + i, " ".join([*(f"s{i}x{j}" for j in range(60)), *passage])) for i in range(30)]
    got = ngram_join.join_similar(make(rows), bucket=bucket, block=block).collect()
    assert collections.Counter(map(tuple, got)) == plain_classes(rows)


def test_runs_follow_the_recall():
    assert ngram_join.runs_for(0.999, 0.8) > ngram_join.runs_for(0.9, 0.8) >= 1


def test_join_of_an_empty_table(make):
    assert ngram_join.join_similar(make([])).count() == 0
    assert [tuple(r) for r in ngram_join.join_similar(make([(1, None), (2, " ")])).orderBy("shipment_id").collect()] == [(1, 1, 0), (2, 2, 0)]


def mixed(make, n=600):
    rng = np.random.default_rng(4)
    hubs = [None if i % 50 == 0 else "Pune" if i % 3 == 0 else f"hub{i % 7}" for i in range(n)]
    table = make([(i, "x") for i in range(n)], hubs)
    tokens = {i: int(rng.integers(1, 500)) for i in range(n)}
    value = F.element_at(F.create_map(*[F.lit(x) for p in tokens.items() for x in p]), F.col("shipment_id").cast("int"))
    table = table.withColumn("goods_type", F.element_at(F.array(*map(F.lit, ("steel", "fmcg", None, "fmcg", "steel"))), F.col("shipment_id").cast("int") % 5 + 1))
    return table.withColumn("n_tokens", value).withColumn("wave", F.when(F.col("n_tokens") < 200, "early").otherwise("late"))


def test_mix_meets_the_targets(make):
    table = mixed(make)
    got = mixing.mix_shipments(table).toPandas()
    targets = mixing.tempered_targets(table).toPandas()
    expected = got.n_tokens * got.probability
    for _, t in targets.iterrows():
        share = expected[got[t.dimension] == t["value"]].sum() / expected.sum()
        assert abs(share - t.share) < 1e-3
    assert got.probability.max() == pytest.approx(1) and len(got) == 600
    halved = mixing.mix_shipments(table, keep=0.5).toPandas()
    assert (halved.n_tokens * halved.probability).sum() / halved.n_tokens.sum() == pytest.approx(0.5, abs=0.01)


def test_raking_matches_numpy(spark):
    cells = [(a, b, float(n)) for (a, b), n in zip(itertools.product("xy", "pqr"), (5, 1, 7, 2, 9, 4))]
    want = {("d1", "x"): 0.3, ("d1", "y"): 0.7, ("d2", "p"): 0.5, ("d2", "q"): 0.25, ("d2", "r"): 0.25}
    targets = spark.createDataFrame([(d, v, s) for (d, v), s in want.items()], "dimension string, value string, share double")
    table = spark.createDataFrame(cells, "d1 string, d2 string, n_tokens double")
    got = {(r.d1, r.d2): r.weight for r in mixing.rake(table, targets, ("d1", "d2"), tolerance=1e-9, most_rounds=60).collect()}
    w = np.array([c[2] for c in cells]).reshape(2, 3)
    for _ in range(200):
        w *= (np.array([0.3, 0.7]) / w.sum(1))[:, None]
        w *= np.array([0.5, 0.25, 0.25]) / w.sum(0)
    assert np.allclose([got[a, b] for a, b, _ in cells], w.ravel(), atol=1e-7)


def test_missed_targets_are_told(make):
    table = mixed(make, 600)
    targets = mixing.tempered_targets(table).toPandas()
    share = {(t.dimension, t["value"]): t.share for _, t in targets.iterrows()}
    assert mixing.mix_shipments(table, gaps=True).toPandas().gap.max() < 1e-3
    got = mixing.mix_shipments(table, keep=0.97, gaps=True).toPandas()
    expected = got.n_tokens * got.probability
    held = {(d, v): expected[got[d] == v].sum() / expected.sum() for d, v in share}
    want = got.apply(lambda r: max(abs(held[d, r[d]] - share[d, r[d]]) for d in mixing.DIMENSIONS), axis=1)
    assert np.allclose(got.gap, want, atol=1e-9) and got.gap.max() > 1e-3
    assert mixing.mix_shipments(table.limit(0), gaps=True).count() == 0
    none = mixing.mix_shipments(table.withColumn("n_tokens", F.lit(None).cast("long")), gaps=True)
    assert none.filter("gap <> 0").count() == 0


def test_mix_edges(make, spark):
    table = mixed(make, 12)
    none = table.withColumn("n_tokens", F.lit(None).cast("long"))
    assert mixing.mix_shipments(none).filter("selected").count() == 0
    assert mixing.mix_shipments(table.limit(0)).count() == 0
    twice = mixing.mix_shipments(table.union(table)).groupBy("shipment_id").agg(F.countDistinct("selected").alias("n"), F.count("*").alias("rows"))
    assert twice.filter("n <> 1 OR rows <> 2").count() == 0


def test_tokens_are_parted_by_any_blank(make, odd_rows):
    from haulplan.llm import queries

    rows = odd_rows + [(20, "a\nb\tc  d\r\ne\x0bf\x0cg"), (21, "item\n" * 250), (22, "\n\n\t"), (23, "a\xa0b\u2003c d")]
    got = queries.with_tokens(make(rows)).collect()
    want = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows]
    assert [(r.shipment_id, r.n_tokens) for r in got] == want
    assert [r.wave for r in got[-4:]] == ["short", "medium", "short", "short"]


def test_one_rare_source_does_not_thin_the_mix(spark, tmp_path):
    import corpus_pipeline
    from haulplan.llm import queries

    rows = [(i, "word " * (100 + i % 7 * 50), "en", f"s{i % 4}", 1) for i in range(400)] + [(900, "one two", "en", "rare", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_mixing(spark, str(tmp_path)).toPandas()
    assert (got.n_tokens * got.probability).sum() >= 0.5 * got.n_tokens.sum()
    assert got[got.source == "rare"].probability.item() == pytest.approx(1)
    common = got[(got.source != "rare") & (got.probability < 1)]
    per_token = common.probability * common.n_tokens.groupby([common.source, common.topic]).transform("sum") / common.weight
    assert per_token.max() == pytest.approx(per_token.min())
    kept = {r.doc_id for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()}
    assert 900 in kept and len(kept) > 0.65 * len(rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(np.random.default_rng(i).choice(words, 40)) + "\nthe line that everyone shares here", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, rows[0][1], "en", "s1", 1), (51, None, None, None, None), (52, "", "de", "s0", 0), (52, "", "de", "s0", 0)]
    labels = [(i, 1, int(i == 3)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} <= {r[0] for r in rows} and all(r.length > 0 for r in pieces)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == [*range(40), 51, 52]
    lines = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()}
    assert "everyone shares" in lines[50] and not any("everyone shares" in (lines[i] or "") for i in range(40))
