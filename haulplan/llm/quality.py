"""Rule ledger: every rule evaluated once, kept as bits, judged by versioned policies.

A ledger row holds a record's measurements and one integer of failure bits.
Policies are sets of rules under a version; a verdict is one bitwise test, and
ablations come from counting the bit patterns, without looking at records again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, key_type, map_batches, rows_of


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the record's columns; null counts as not failed."""

    name: str
    fails: str


#: Rules on a free text's measurements. The order gives the bits; add new ones at the end.
TEXT_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 50 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_text_lines"),
    Rule("capitals", "100 * n_capitals > 60 * word_chars"),
    Rule("word_length", "word_chars > 25 * n_words"),
)

#: Rules on a shipment's own fields, for the same ledger.
SHIPMENT_RULES = (
    Rule("no_weight", "weight_kg IS NULL OR NOT weight_kg > 0"),
    Rule("no_pickup", "pickup_lat IS NULL OR pickup_lng IS NULL"),
    Rule("no_delivery", "delivery_lat IS NULL OR delivery_lng IS NULL"),
    Rule("outside_region", "NOT (pickup_lat BETWEEN 6 AND 38 AND pickup_lng BETWEEN 68 AND 98)"),
    Rule("over_payload", "weight_kg > 22000"),
)

#: Version -> names of the rules that reject.
TEXT_POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "capitals", "word_length"),
}

SYMBOLS = b"#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + again.size] |= again
    return int(inside.sum())


def measure_texts(shipments: DataFrame) -> DataFrame:
    """Measurements of every shipment's whole text.

    Words are runs without blanks. ``word_chars`` counts their code points,
    ``n_symbols`` the characters of ``#*$%&|<>``, ``n_capitals`` A-Z,
    ``n_text_lines`` lines with a word, ``n_dup_lines`` those equal to an earlier
    line, ``n_repeat_words`` words in repeated three-word windows. A null or
    empty text measures zero throughout.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_text_lines", "n_dup_lines", "n_repeat_words")

    def measure(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in as_bytes(rows_of(batch, "delivery_hub")):
            words = text.split()
            lines = [x for x in text.split(b"\n") if x.strip()]
            rows.append((
                len(words), sum(len(w) for w in words) if text.isascii() else len(b"".join(words).decode("utf-8", "replace")),
                len(text) - len(text.translate(None, SYMBOLS)), len(text) - len(text.translate(None, _CAPITALS)),
                len(lines), len(lines) - len(set(lines)), repeat_words(words),
            ))
        columns = np.array(rows, np.int64).T
        return {"shipment_id": rows_of(batch, "shipment_id")} | dict(zip(names, columns))

    columns = ", ".join(f"{n} long" for n in names)
    return map_batches(shipments.select("shipment_id", "delivery_hub"), measure, f"shipment_id {key_type(shipments)}, {columns}")


def rule_ledger(records: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``records`` with ``failed_rules``: bit i is set where rule i fails."""
    if len(rules) > 62:
        raise ValueError("a ledger has room for 62 rules")
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(0).cast("long") for i, r in enumerate(rules)]
    ledger = F.lit(0).cast("long")
    for bit in bits:
        ledger = ledger.bitwiseOR(bit)
    return records.withColumn("failed_rules", ledger)


def policy_bits(rules: tuple[Rule, ...], names: tuple[str, ...]) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in set(names))


def passes(rules: tuple[Rule, ...], names: tuple[str, ...]) -> Column:
    """Verdict of a policy on a ledger row."""
    return F.col("failed_rules").bitwiseAND(F.lit(policy_bits(rules, names))) == 0


def ablations(ledger: DataFrame, rules: tuple[Rule, ...], policies: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per policy version and rule: records it fails, fails alone, and kept without it.

    Records are first counted by bit pattern (2^rules at most), on the map side.
    """
    patterns = ledger.groupBy("failed_rules").agg(F.count("*").alias("n"))
    rows = [
        F.struct(F.lit(v).alias("policy"), F.lit(n).alias("rule"), F.lit(policy_bits(rules, names)).cast("long").alias("mask"),
                 F.lit(policy_bits(rules, (n,))).cast("long").alias("bit"))
        for v, names in policies.items() for n in names
    ]
    hit, own = F.col("failed_rules").bitwiseAND(F.col("mask")), F.col("failed_rules").bitwiseAND(F.col("bit")) != 0
    none = F.lit(0).cast("long")
    return (
        patterns.select("failed_rules", "n", F.inline(F.array(*rows)))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(own, F.col("n")).otherwise(none)).alias("n_failed"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(none)).alias("n_failed_alone"),
            F.sum(F.when(hit == 0, F.col("n")).otherwise(none)).alias("n_kept"),
            F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(none)).alias("n_kept_without"),
        )
    )


def text_ledger(shipments: DataFrame) -> DataFrame:
    """Measurements and failure bits of every text; repeated rows give equal rows, an empty table none."""
    return rule_ledger(measure_texts(shipments), TEXT_RULES)
