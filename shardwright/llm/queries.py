"""The opN_<name> queries: each applies its operator to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardwright.llm import ann, clustering, contamination_sql, conversation_sql, conversations, decontam, html_extract, langid, licenses, lm, mixing, quality, rules, simhash, warc
from shardwright.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.self_search(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustering(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_language_id, op2_decontamination, op3_warc_index, op4_license_scan, op5_lm_scoring, op6_source_mixing, op7_simhash_dedup)
    rest = (op8_html_extraction, op9_nearest_neighbours, op10_quality_classifier, op11_centroid_clustering, op12_quality_rules, op13_conversation_repair)
    return {f.__name__: f for f in (*first, *rest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": contamination_sql.CONTAMINATION_SQL,
        "op3_warc_index": warc.WARC_SQL,
        "op4_license_scan": licenses.license_sql(),
        "op6_source_mixing": mixing.mixing_sql(),
        "op11_centroid_clustering": clustering.clustering_sql(),
        "op13_conversation_repair": conversation_sql.REPAIR_SQL,
    }
