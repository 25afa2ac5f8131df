"""Corpus cleaning in five stages, each written and read again between: the last returns token digests.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import bpe, decontam, entry, langid, neardup, pii
from strideframe.llm.common import materialise, release, table, tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised."""
    tune(spark)
    return langid.keep_identified(docs, entry.PIECES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, Jaccard 0.8)."""
    tune(spark)
    return neardup.drop_near_duplicates(docs, n=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a bracketed kind in the place of personal data."""
    tune(spark)
    return pii.redact(docs, pii.fit(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode the texts: counts and digests of ids and bytes."""
    tune(spark)
    return bpe.digest(docs, entry.RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: Language models and byte merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:  # the table of the stage before is read no more
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
