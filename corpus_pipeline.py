"""Corpus cleaning in four stages: toxicity, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept
and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from labelweave.llm import packing, quality, simhash, toxicity
from labelweave.llm.steps import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity score that rejects; empty texts are scored too."""
    return toxicity.kept(docs.select(*COLUMNS), _labels(spark, sf_dir), teach=toxicity.kneser_ney_ratios)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within the quantile of trusted texts of their language."""
    return quality.kept(docs.select(*COLUMNS), _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints."""
    return simhash.one_per_group(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document that is left, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

# Language models, hashes and tokenizers have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
