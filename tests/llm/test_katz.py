import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulplan.llm import katz

NAMES = ("shipment_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


class PlainKatz:
    """Counts in dicts, one recursive probability; shares only the discounts' formula with the package by its definition."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for tokens in texts:
            seq = ["<s>", *tokens, "</s>"]
            for k in range(1, order + 1):
                for i in range(max(k - 1, 1), len(seq)):
                    self.counts[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.keeps = [None] + [self.discount(self.counts[k]) for k in range(1, order + 1)]
        self.after = [None, None] + [defaultdict(dict) for _ in range(2, order + 1)]
        for k in range(2, order + 1):
            for gram, c in self.counts[k].items():
                self.after[k][gram[:-1]][gram[-1]] = c

    @staticmethod
    def discount(counts):
        met = Counter(counts.values())
        for most in range(5, 0, -1):
            if not all(met[r] for r in range(1, most + 2)) or (most + 1) * met[most + 1] / met[1] >= 1:
                continue
            b = (most + 1) * met[most + 1] / met[1]
            keep = {r: ((r + 1) * met[r + 1] / met[r] / r - b) / (1 - b) for r in range(1, most + 1)}
            if all(0 < x < 1 for x in keep.values()):
                return keep
        return {}

    def kept(self, k, c):
        return c * self.keeps[k].get(c, 1.0)

    def p(self, word, history):
        history = history[-(self.order - 1) :] if self.order > 1 else ()
        k = len(history) + 1
        if k == 1:
            mass = sum(self.kept(1, c) for c in self.counts[1].values())
            over = self.n if mass < self.n - 1e-9 else self.n + 1
            c = self.counts[1].get((word,), 0)
            return self.kept(1, c) / over if c else 1 - mass / over
        seen = self.after[k].get(history)
        if not seen:
            return self.p(word, history[1:])
        total, mass = sum(seen.values()), sum(self.kept(k, c) for c in seen.values())
        over = total if mass < total * (1 - 1e-12) else total + 1
        if word in seen:
            return self.kept(k, seen[word]) / over
        return (1 - mass / over) / (1 - sum(self.p(w, history[1:]) for w in seen)) * self.p(word, history[1:])

    def score(self, tokens):
        seq, total = ["<s>", *tokens, "</s>"], 0.0
        for i in range(1, len(seq)):
            total += math.log10(self.p(seq[i], tuple(seq[max(0, i - self.order + 1) : i])))
        return total


def tokens_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def plain(rows, order):
    model = PlainKatz([tokens_of(t) for i, t in rows if not held(i)], order)
    out = []
    for i, t in rows:
        seq = [*tokens_of(t), "</s>"]
        counts = [model.counts[1].get((w,), 0) for w in seq]
        base = sum(math.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1))) for c in counts)
        out.append((i, held(i), len(seq), sum(c > 0 for c in counts), model.n, base, model.score(seq[:-1])))
    return out


def scored(frame, order):
    rows = katz.score_texts(frame, F.crc32(F.col("shipment_id").cast("string")) % 5 == 1, order).collect()
    return [tuple(r[n] for n in NAMES) for r in rows]


def same(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def corpus(n, seed=3):
    """Zipf words with a habit: counts of counts that Good-Turing can discount."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        words = rng.zipf(1.6, rng.integers(0, 30)) % 60
        texts.append((i, " ".join(f"W{w}" if k % 3 else f"w{w + i % 2}" for k, w in enumerate(words))))
    return texts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_recursive_model(spark, make, order, monkeypatch):
    rows = corpus(150)
    same(scored(make(rows).repartition(3), order), plain(rows, order))


def test_many_batches_and_shards_give_the_same_scores(spark, make, monkeypatch):
    rows = corpus(150)
    want = plain(rows, 2)
    monkeypatch.setattr(katz, "BATCH_BYTES", 300)
    monkeypatch.setattr(katz, "SHARD_TOKENS", 150)
    same(scored(make(rows).repartition(4), 2), want)


def test_odd_texts(spark, make, odd_rows):
    rows = [(i, t) for i, t in odd_rows if len(t or "") < 100_000]
    same(scored(make(rows), 3), plain(rows, 3))


def test_every_history_sums_to_one(spark, make):
    rows = [(i, t) for i, t in corpus(120) if not held(i)]
    model = PlainKatz([tokens_of(t) for _, t in rows], 3)
    words = [w for (w,) in model.counts[1]] + ["unknown"]
    for history in [(), *list(model.after[2])[:20], *list(model.after[3])[:20], ("unknown", "w1")]:
        assert sum(model.p(w, history) for w in words) == pytest.approx(1.0, abs=1e-9)
    _, fitted = katz.fit_and_score(make(rows), order=3)
    tables = fitted.rows(fitted.counts, ("counts", np.int64)).groupBy("order").agg(F.count("*").alias("n"), F.sum("counts").alias("c")).collect()
    assert {r["order"]: (r["n"], r["c"]) for r in tables} == {k: (len(model.counts[k]), sum(model.counts[k].values())) for k in (1, 2, 3)}
    weights = fitted.rows(fitted.weights, ("denominator", np.int64), ("backoff", np.float64)).groupBy("order").count().collect()
    assert {r["order"]: r["count"] for r in weights} == {k: len(model.after[k]) for k in (2, 3)}


def test_a_very_long_text_and_string_ids(spark):
    rows = [("S1", "long text " * 60_000), ("S2", None), ("S3", "long haul")]
    frame = spark.createDataFrame(rows, "shipment_id string, delivery_hub string")
    got = {r.shipment_id: r for r in katz.score_texts(frame).collect()}
    model = PlainKatz([tokens_of(t) for _, t in rows], 2)
    for i, t in rows:
        assert got[i].score == pytest.approx(model.score(tokens_of(t)), rel=1e-9)


def test_nothing_to_learn_and_nothing_to_score(spark, make):
    assert scored(make([]), 2) == []
    rows = katz.score_texts(make([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in sorted(rows)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_the_model_knows_held_out_texts_better_than_single_words(spark, make):
    rng, rows = np.random.default_rng(1), []
    for i in range(400):  # a word is followed by one of two words
        word, text = int(rng.integers(40)), []
        for _ in range(60):
            text.append(f"w{word}")
            word = (word * 7 + int(rng.integers(2))) % 40
        rows.append((i, " ".join(text)))
    got = scored(make(rows), 2)
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > 0.6 * sum(r[5] for r in out)
