"""Registered queries: the given documents in the shipments' interface, and results back.

A document stands as a shipment: its id is the ``shipment_id``, its text the
free text ``delivery_hub``, its source the ``pickup_hub``, its language the
``goods_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, fingerprints, katz, licenses, line_dedup, merkle, mixing, ngram_join, packing, quality, secrets, suffix_index, toxicity


#: The mix keeps this share of the tokens at least, whatever the rarest value holds.
MIX_LEAST = 0.5


def shipments(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("shipment_id"), F.col("text").alias("delivery_hub"),
        F.col("source").alias("pickup_hub"), F.col("lang").alias("goods_type"), *more,
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return shipments(spark.read.parquet(f"{sf}/documents.parquet"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/labels.parquet")
    return table.select(F.col("doc_id").alias("shipment_id"), "toxic")


def with_tokens(rows: DataFrame) -> DataFrame:
    """Words as tokens, and a size class: documents have no topic, so it stands as the wave."""
    tokens = F.regexp_count(F.coalesce("delivery_hub", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = rows.withColumn("n_tokens", tokens.cast("long"))
    size = F.when(F.col("n_tokens") < 200, "short").when(F.col("n_tokens") < 1000, "medium").otherwise("long")
    return rows.withColumn("wave", size)


def doc_id():
    return F.col("shipment_id").alias("doc_id")


def op1_line_dedup(spark, sf):
    kept = line_dedup.drop_shared_lines(documents(spark, sf))
    return kept.select(doc_id(), "n_lines", "n_dropped", F.sha2("delivery_hub", 256).alias("kept_sha256"))


def op2_secrets(spark, sf):
    found = secrets.find_secrets(documents(spark, sf))

    def of(*kinds):
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    return found.select(
        doc_id(), *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(digest(of(*secrets.KINDS[:3])), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
    )


def op3_quality(spark, sf):
    ledger, rules, policies = quality.text_ledger(documents(spark, sf)), quality.TEXT_RULES, quality.TEXT_POLICIES
    return ledger.select(
        doc_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(rules, policies["base"])).alias("base_failed"),
        quality.passes(rules, policies["v2"]).alias("kept"), "failed_rules",
    )


def op4_ngram_join(spark, sf):
    return ngram_join.join_similar(documents(spark, sf)).select(doc_id(), "class_id", "n_links")


def op5_packing(spark, sf):
    pieces = packing.pack_texts(documents(spark, sf))
    return pieces.select(
        doc_id(), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("text_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )


def op6_suffix_dedup(spark, sf):
    cut = suffix_index.remove_repeats(documents(spark, sf))
    return cut.select(
        doc_id(), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        "n_passages",
    )


def op7_mixing(spark, sf):
    mixed = mixing.mix_shipments(with_tokens(documents(spark, sf)), least_keep=MIX_LEAST, gaps=True)
    return mixed.select(
        doc_id(), F.col("pickup_hub").alias("source"), F.col("goods_type").alias("lang"), F.col("wave").alias("topic"),
        "n_tokens", "weight", "probability", "selected", "gap",
    )


def op8_licenses(spark, sf):
    found = licenses.find_licenses(documents(spark, sf))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.col("places.word")
    return found.select(
        doc_id(), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "matches.label")).alias("labels"), "score",
    )


def op9_fingerprints(spark, sf):
    prints = fingerprints.edited_fingerprints(documents(spark, sf))
    return prints.select(
        doc_id(), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op10_toxicity(spark, sf):
    scored = toxicity.score_toxicity(documents(spark, sf), labels(spark, sf))
    return scored.select(doc_id(), "held_out", "score", "predicted")


def op11_katz(spark, sf):
    scores = katz.score_texts(documents(spark, sf), F.crc32(F.col("shipment_id").cast("string")) % 5 == 1)
    return scores.select(doc_id(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_filter_audit(spark, sf):
    table = spark.read.parquet(f"{sf}/labels.parquet")
    return filter_audit.filter_interactions(documents(spark, sf), table.withColumnRenamed("doc_id", "shipment_id"))


def op13_merkle(spark, sf):
    rows, id_text, text = shipments(spark.read.parquet(f"{sf}/documents.parquet"), "n_chars"), F.col("shipment_id").cast("string"), F.col("delivery_hub")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sealed = merkle.manifest(
        rows, fields=("shipment_id", "pickup_hub", "goods_type", "n_chars", "delivery_hub"),
        received={"delivery_hub": F.when(F.crc32(id_text) % 3 == 0, lower).otherwise(text)},
    )
    return sealed.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_ngram_join": op4_ngram_join,
    "op5_packing": op5_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_katz": op11_katz,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}
