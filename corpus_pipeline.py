"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of `documents`. `run` writes
each stage's rows in the shared folder and reads them again as the next stage's documents.

Null and empty texts are documents like any other: the classifier scores them, all of them are one exact copy (the largest id stays, null ids last), they hold no
window and give no ids. Texts of any length are read whole. Rows that repeat both id and text are judged each by the first and the fourth stage, and one of them stays after the
second. Columns beside those of `documents` are kept by all stages but the last, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from velarium.llm import bpe, decontaminate, exact_dedup, quality_rules, simhash
from velarium.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_quality(docs, rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what stays."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", leaks), ("bpe", tokens)]

#: Models, fingerprints and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
