"""Toxicity of free text by a factorization machine over hashed terms.

Terms are a text's words and their leading letters, hashed. The machine scores
w0 + sum of w_i + sum over pairs of <v_i, v_j>: besides the additive weights it
learns which terms are harmful together, such as an insult and a group's name.

It is fitted on a bounded sample of labelled rows; scoring covers every text.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONGEST_REMEMBERED, map_batches, rows_of, schema_of, stages, worker_memory

WORD = re.compile(r"\w+")
#: Lengths of the leading letters that are terms of their own: stems of unseen forms.
STEMS = (4, 5, 6)
#: Most remembered words of a worker; the memory starts anew beyond it.
REMEMBERED = 300_000


def terms_of(word: str) -> list[int]:
    """Hashes of the terms of one lower-case word."""
    out = [xxhash.xxh32_intdigest("=" + word)]
    out += [xxhash.xxh32_intdigest(f"{n}" + word[:n]) for n in STEMS if len(word) >= n]
    return [t - (1 << 31) for t in out]


def held_out(shipment_id: str = "shipment_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.col(shipment_id).cast("string")) % 5 == 0


@dataclass(frozen=True)
class Machine:
    """Terms kept by the screens, ascending, with linear weights and factors."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, present: np.ndarray) -> float:
        """Score from the indices of the terms present."""
        v = self.factors[present]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        z = self.bias + float(self.linear[present].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


#: Rows whose presence of terms is held as numbers at a time; the sample itself takes a byte each.
ROWS_AT_ONCE = 2048


def presence(rows: list[np.ndarray], n_terms: int) -> np.ndarray:
    """Which terms a row has, one byte each."""
    x = np.zeros((len(rows), n_terms), bool)
    for i, present in enumerate(rows):
        x[i, present] = True
    return x


def joint_terms(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, most: int, at_least: float = 10.0) -> np.ndarray:
    """Indices of terms that tell the label only together with another, by their strongest pair.

    ``rows`` hold the indices of the terms present. A pair's strength is the sum of
    (label - mean) (a - mean) (b - mean) over all rows in standard errors: nought
    where each term only adds its own share, large where, say, an insult
    matters with a group's name alone. All pairs are told by one matrix
    product in blocks of terms.
    """
    if not rows or not n_terms:
        return np.empty(0, np.int64)
    x = presence(rows, n_terms)
    share = x.sum(0).astype(np.float32) / np.float32(len(rows))
    off = (labels - labels.mean()).astype(np.float32)
    spread = np.sqrt(share * (1 - share))
    best = np.zeros(n_terms)
    for a in range(0, n_terms, 512):
        part = slice(a, a + 512)
        joint = np.zeros((share[part].size, n_terms), np.float32)
        for r in range(0, len(rows), ROWS_AT_ONCE):
            some = x[r : r + ROWS_AT_ONCE] - share
            joint += (some[:, part] * off[r : r + ROWS_AT_ONCE, None]).T @ some
        np.abs(joint, out=joint)
        joint /= np.sqrt(len(rows) * max(float((off**2).mean()), 1e-9)) * np.maximum(np.outer(spread[part], spread), 1e-6)
        joint[len(rows) * np.outer(share[part], share) < 10] = 0  # too few rows hold both
        joint[np.arange(joint.shape[0]), np.arange(a, a + joint.shape[0])] = 0
        best[part] = joint.max(1)
    first = np.argsort(-best, kind="stable")[:most]
    return np.sort(first[best[first] >= at_least])


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, rank: int, epochs: int = 60, seed: int = 7) -> Machine:
    """Adam on the logistic loss; ``rows`` hold the indices of the terms present."""
    x = presence(rows, terms.size)
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    p = [np.array([np.log(share / (1 - share))]), np.zeros(terms.size), rng.normal(0, 0.02, (terms.size, rank))]
    m, s, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs if len(rows) and terms.size else 0):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512)):
            xb, step = x[batch].astype(np.float32), step + 1
            sums = xb @ p[2]
            z = p[0] + xb @ p[1] + 0.5 * ((sums**2).sum(1) - (xb @ (p[2] ** 2).sum(1)))
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            pull = (xb * off[:, None]).T
            grads = [off.sum(keepdims=True), pull @ np.ones(len(batch)) + 2e-5 * p[1], pull @ sums - p[2] * (pull.sum(1)[:, None]) + 2e-4 * p[2]]
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32))


def rows_in(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column, as views of one array."""
    out: list[np.ndarray] = []
    for chunk in lists.chunks:
        flat, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out fold, by the smallest hash of their id."""
    one = labels.filter(~held_out()).groupBy("shipment_id").agg(F.max("toxic").alias("toxic")).filter("toxic IS NOT NULL")
    return one.orderBy(F.xxhash64("shipment_id"), "shipment_id").limit(most)


def learn(
    shipments: DataFrame, labels: DataFrame, sample: int = 12_000, kept_terms: int = 1024, rank: int = 8, paired_terms: int = 2048
) -> Machine:
    """Fit the machine from ``labels`` (shipment_id, toxic 0/1).

    ``sample`` bounds the labelled rows, ``kept_terms`` the terms: those whose
    counts differ most between the classes, by three standard errors at least.
    Terms that tell the label only with another come from all pairs of the
    ``paired_terms`` that vary most over the sample; a quarter of ``kept_terms``
    at most joins the others. All bounds are parameters of the
    fit, so what is gathered for it does not grow with the table. Without
    labelled rows the machine says 0.5 for every text.
    """
    run = stages(shipments.sparkSession, "toxicity")
    chosen = F.broadcast(run.save(labelled_sample(labels, sample), "labelled"))
    texts = shipments.select("shipment_id", "delivery_hub").join(chosen, "shipment_id").drop("shipment_id")

    def terms(batch: pa.RecordBatch) -> dict:
        lists = []
        for text in rows_of(batch, "delivery_hub").to_pylist():
            lists.append(sorted({t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)}))
        return {"toxic": rows_of(batch, "toxic").cast(pa.int32()), "terms": pa.array(lists, pa.list_(pa.int32()))}

    rows = run.save(map_batches(texts, terms, "toxic int, terms array<int>"), "terms")
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad, n = int(totals[0] or 0), int(totals[1])
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    counts = run.save(counts.filter("n >= 3"), "counts")
    # share among toxic rows against share among others, in standard errors
    p_bad, p_good = F.col("bad") / max(bad, 1), (F.col("n") - F.col("bad")) / max(n - bad, 1)
    pooled = F.col("n") / max(n, 1)
    gap = F.abs(p_bad - p_good) / F.sqrt(pooled * (1 - pooled) + F.lit(1e-4))
    best = counts.filter(gap * math.sqrt(bad * (n - bad) / max(n, 1)) >= 3).orderBy(gap.desc(), "term").limit(kept_terms)
    varied = counts.orderBy((pooled * (1 - pooled)).desc(), "term").limit(paired_terms)
    alone, often = (np.array([r["term"] for r in d.select("term").collect()], np.int64) for d in (best, varied))
    read = np.union1d(alone, often)

    def keep(batch: pa.RecordBatch) -> dict:
        lists = [np.flatnonzero(np.isin(read, np.array(t, np.int64))).tolist() for t in rows_of(batch, "terms").to_pylist()]
        return {"toxic": rows_of(batch, "toxic"), "terms": pa.array(lists, pa.list_(pa.int32()))}

    # at most ``sample`` rows, as flat arrays: lists of Python numbers would take ten times the driver's memory
    few = map_batches(rows, keep, "toxic int, terms array<int>").toArrow().combine_chunks()
    toxic, found = few.column("toxic").to_numpy().astype(float), rows_in(few.column("terms"))

    def among(these: np.ndarray) -> list[np.ndarray]:
        slot = np.full(read.size, -1)
        slot[np.isin(read, these)] = np.arange(these.size)
        return [at[at >= 0] for at in (slot[t] for t in found)]

    paired = np.sort(often)
    joint = paired[joint_terms(among(paired), toxic, paired.size, kept_terms // 4)]
    kept = np.union1d(alone, joint)
    return fit_machine(among(kept), toxic, kept, rank)


def score_toxicity(
    shipments: DataFrame, labels: DataFrame, sample: int = 12_000, kept_terms: int = 1024, rank: int = 8, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Toxicity of every shipment's whole text.

    ``labels`` (shipment_id, toxic) teach the machine, but for the held-out
    fold; beside them only the text counts. The project's own labels, such as
    a truck's feasible flag over the terms of its explanation, fit as well.

    Returns one row per input row: ``shipment_id``, ``held_out``, ``score``
    (0 to 1), ``predicted`` (1 from 0.5 on), and the columns named in ``carry``. A null or empty text gets the
    score of no terms. An empty table gives no rows.
    """
    machine = learn(shipments, labels, sample, kept_terms, rank)
    context = shipments.sparkSession.sparkContext
    # kept_terms x (rank + 1) numbers, as plain arrays
    shared = context.broadcast((machine.terms, machine.bias, machine.linear, machine.factors))
    fit = uuid.uuid4().hex

    def score(batch: pa.RecordBatch) -> dict:
        own, memory = Machine(*shared.value), worker_memory("terms", fit)
        index = {int(t): i for i, t in enumerate(own.terms)}
        scores = []
        for text in rows_of(batch, "delivery_hub").to_pylist():
            present: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                known = memory.get(word)
                if known is None:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    known = tuple(index[t] for t in terms_of(word) if t in index)
                    if len(word) <= LONGEST_REMEMBERED:
                        memory[word] = known
                present.update(known)
            scores.append(own.score(np.array(sorted(present), np.int64)))
        return {c: rows_of(batch, c) for c in kept} | {"score": pa.array(scores, pa.float64())}

    kept = ("shipment_id", *carry)
    read = shipments.select(*dict.fromkeys((*kept, "delivery_hub")))
    scored = map_batches(read, score, f"{schema_of(shipments, kept)}, score double")
    return scored.select(
        *kept, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
