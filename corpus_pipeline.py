"""The corpus pipeline: five stages from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's documents.  All stages but the last return the columns of
documents; each works on everything its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecstrata.llm import decontam, packing, quality, secret_scan, simhash
from vecstrata.scratch import discard, materialize, temporary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: low quality, toxic, or without a word, as null
    and empty texts are.  Repeated rows stay or go together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group alike by 0.8 or more in 5-word shingles, the smallest
    doc_id (null ids last; of repeated rows the one read first).  Null and empty texts are a
    group."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % of their words in benchmark windows go; other hits are cut out.
    Null and empty texts stay as they are, repeated rows are answered alike."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; a null text stays null."""
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, packed into sequences of 2048; a null or empty text is its
    separator, repeated rows are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Neither a trained model nor SimHash over shingles, nor genetic packing, is SQL's to say;
#: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each one's rows before the next reads them;
    then what the stage and its predecessor wrote is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            after = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
