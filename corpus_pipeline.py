"""A corpus pipeline of five operators over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns rows with the columns of documents; the last returns the mixed
order with its text. Each result is written as Parquet to the shared folder and
read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.llm import decontam, langid, mixing, near_copies, quality, simhash
from shardwright.llm.common import ensure_checkpoint_dir, release, shielded, stored, table

#: A document goes if fewer of its letters are in words of its language.
MIN_LANGUAGE_SHARE = 0.3
#: A document goes if label 1 is less likely.
MIN_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one recognisable language and sets ``lang`` to it; ``und`` and jumbled ones go.

    The model learns from the rows of this stage's input that have a language. Null texts, and those without a letter, go; repeated rows and ids share their fate.
    """
    inner, restored = shielded(docs, {"text", "lang"}, {"_lang", "_score", "_spans"})
    found = langid.identify(inner, langid.train(docs))
    kept = found.where((F.col("_lang") != "und") & (F.col("_score") >= MIN_LANGUAGE_SHARE))
    return restored(kept.withColumn("lang", F.col("_lang")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, fitted on the labelled ones, takes for label 1. Null counts as the empty text; equal texts share their fate."""
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    inner, restored = shielded(docs, {"text"}, {"_score"})
    return restored(quality.classify(inner, network).where(F.col("_score") >= MIN_QUALITY))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near-copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    SimHash links come first, an exact completion follows. Null and empty texts are alike, and one of them stays;
    rows with null or repeated ids stand for their own texts, equal rows are copies.
    """
    return simhash.keep_one(docs, found=near_copies.near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the benchmark does not contaminate. Null and empty texts stay, and so do repeated rows."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to target weights: a row for each use of a document, with its place and text. Texts without tokens come with whole epochs; rows with null or repeated ids each count."""
    # Ids may be null or repeat, so rows get a key of their own, written once.
    inner, _ = shielded(docs, {"doc_id", "text", "source"}, {"_row", "_mix_n_tokens", "_mix_weight", "_mix_epoch", "_mix_block", "_mix_block_rank", "_mix_position"})
    rows = stored(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
    added = ["n_tokens", "weight", "epoch", "block", "block_rank", "position"]
    have = {c.lower() for c in docs.columns}
    order = mixing.mix(rows, key_col="_row").select("_row", *(F.col(c).alias(f"_mix_{c}") for c in added))
    names = [f"mix_{c}" if c in have else c for c in added]
    return rows.join(order, "_row").select(*inner.columns, *(f"_mix_{c}" for c in added)).toDF(*docs.columns, *names)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixed),
]

#: Language, quality and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        release(spark)
    return docs
