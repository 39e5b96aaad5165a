"""The corpus pipeline: five stages over ``documents``, each reading what the one before kept.

Language identification drops documents in which no learned language is found; the n-gram Jaccard join
keeps one document of each group of near-duplicates; decontamination drops documents that
hold benchmark passages; the secret scan masks secrets in the text; packing lays the
documents out in training sequences by their tokens.  Every stage but the last returns the
columns of ``documents``, further columns of any name included; no stage reads columns that an
earlier one added.  Null and empty texts go with the first stage, texts of any length are read
whole, repeated rows leave one, ties go to the smallest id, and empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabeval.llm import decontaminate, jaccard, langid, packing, pieces, secretscan
from tabeval.llm.common import held_out, saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language or several, by profiles learned from those that are not held out."""
    return langid.accepted(docs, langid.learn(docs.where(~held_out("doc_id", 5, 0))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark windows."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, n_chars anew."""
    return secretscan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences: doc_id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset."""
    return packing.pack(pieces.token_counts(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("pack", pack)]

# The trained language model and the packing order are outside SQL; tests/llm/test_pipeline.py
# checks every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
