"""Documents to packed training sequences: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the
columns of the documents table; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm import line_dedup, mixing, ngram_join, packing, toxicity
from haulplan.llm.common import stages
from haulplan.llm.queries import doc_id, labels, shipments, with_tokens

#: The tempering of the mix: nearer to one keeps more of the corpus.
MIX_POWER = 0.9
#: The share of the tokens that the mix keeps at least: a rare source does not thin the corpus.
MIX_LEAST = 0.75

#: SQL states neither the learnt scores, the token ids nor the packing.
ORACLE_SQL = None


def _documents(rows: DataFrame) -> DataFrame:
    """Shipments' columns back as documents."""
    return rows.select(
        doc_id(), F.col("delivery_hub").alias("text"), F.col("goods_type").alias("lang"), F.col("pickup_hub").alias("source"), "n_chars"
    )


def _rows(docs: DataFrame) -> DataFrame:
    return shipments(docs, "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject."""
    carry = ("delivery_hub", "goods_type", "pickup_hub", "n_chars")
    scored = toxicity.score_toxicity(_rows(docs), labels(spark, sf_dir), carry=carry)
    return _documents(scored.filter("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; a text that loses lines gets a new length."""
    kept = line_dedup.drop_shared_lines(_rows(docs), carry=("goods_type", "pickup_hub", "n_chars"))
    length = F.when(F.col("n_dropped") > 0, F.length("delivery_hub")).otherwise(F.col("n_chars"))
    return _documents(kept.withColumn("n_chars", length.cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies; of equal rows one."""
    classes = ngram_join.join_similar(_rows(docs))
    heads = classes.filter(F.col("shipment_id").eqNullSafe(F.col("class_id"))).select(F.col("shipment_id").alias("_id"))
    kept = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "lang", "source", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and sizes meet tempered shares."""
    mixed = mixing.mix_shipments(with_tokens(_rows(docs)), power=MIX_POWER, least_keep=MIX_LEAST)
    chosen = mixed.filter("selected").select(F.col("shipment_id").alias("_id"))
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.select("doc_id", "text", "lang", "source", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, one row per piece of a document."""
    pieces = packing.pack_texts(_rows(docs))
    return pieces.select(
        doc_id(), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"),
        F.col("text_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table of ``sf_dir``; an empty table ends in no pieces."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), stages(spark, "pipeline")
    for name, stage in STAGES:
        docs = folder.save(stage(spark, docs, sf_dir), name)
    return docs
