"""Training-data pipeline over `documents`: language, near duplicates, repeats, benchmark text, packing.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept, read back from Parquet. All but
the last return the columns of documents. Nulls, repeated rows, ties, empty tables and extra columns are
treated as the operators' docstrings say; a stage never fails on them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from motionloom.llm import decontaminate, langid, packing, simhash, suffix_dedup
from motionloom.llm._common import checkpoint_dir, cut, drop_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the field knows; learns from the labels in docs. Texts without letters go."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    return simhash.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 400 bytes and more that stand elsewhere too out of all texts; n_chars follows."""
    return suffix_dedup.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row per piece."""
    return packing.op7_pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("pack", pack),
]

#: The first and last stages are a trained model and a packing, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for n, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if n + 1 < len(STAGES):
                docs.write.parquet(f"{folder}/{n}")
                docs = spark.read.parquet(f"{folder}/{n}")
        return cut(docs)  # what the last stage returns stands by itself, so that the copies in between can go
    finally:
        drop_folder(spark, folder)
