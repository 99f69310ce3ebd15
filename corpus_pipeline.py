"""From raw documents to packed training sequences: language, repeated lines, near duplicates, packing.

Every stage works on all that the one before it kept. Each result is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenforge.llm import jaccard_join, language_id, line_dedup, packing
from lumenforge.llm.common import delete, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not accepted go."""
    return language_id.accepted_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing but white space is left by that."""
    out = line_dedup.dedup_lines(docs, runs=True)
    return out.where("lines_removed = 0 OR trim(translate(text, '\\n\\t\\r', '   ')) <> ''").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("best_fit_packing", pack)]

#: Tokens, n-gram models and packing aren't SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/lumenforge/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # read for the last time
            delete(spark, before)
        before = path
    return docs
