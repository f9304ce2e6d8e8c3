"""A training-data pipeline: five operators, each over all documents that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import bpe, decontaminate, jaccard_join, language_id, secret_scan
from mailsift.llm.common import table
from mailsift.session import shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told; the model learns from the given languages."""
    return language_id.keep_identified(docs, language_id.learn(language_id.learned_rows(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    parts = decontaminate.benchmark_parts(table(spark, sf_dir, "benchmark"))
    return decontaminate.remove_contaminated(docs, parts)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, those under encodings included; ``n_chars`` follows the text."""
    clean = secret_scan.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact),
    ("bpe", encode),
]

#: SQL cannot express the stages; tests compare their operators, one by one, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{path}/{number}-{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{path}/{number}-{name}")
    return docs
