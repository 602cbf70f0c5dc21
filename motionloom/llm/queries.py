"""Queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, langid, licenses, lm_score, order_minhash, packing, quality, simhash, suffix_dedup, token_align, toxicity, warc
from ._common import table


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2_groups(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.op3_fingerprints(table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4_round_trip(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op5_removed(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op7_pack(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op8_labels(table(spark, sf_dir, "documents"))


def op9_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.op9_scores(table(spark, sf_dir, "documents"))


def op10_language_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10_languages(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op11_audit(table(spark, sf_dir, "documents"))


def op12_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op12_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.op13_alignments(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_discriminant": op1_quality_discriminant,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_order_minhash": op3_order_minhash,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_recurrent_lm": op9_recurrent_lm,
    "op10_language_field": op10_language_field,
    "op11_source_divergence": op11_source_divergence,
    "op12_toxic_neighbours": op12_toxic_neighbours,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
}
