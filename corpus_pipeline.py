"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage works on all that its predecessor kept. A stage takes (spark, docs, sf_dir) and returns a DataFrame,
which is written and read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, jaccard, pii, quality, sentencepiece
from tickloom.llm._common import Stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which the ordinal regression expects the highest grade. Trained on the labelled documents."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.selected(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each component of linked documents."""
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least 5 % of the words stand in windows of benchmark items."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars is that of the new text."""
    return pii.masked(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of the whole text."""
    return sentencepiece.encoded(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: Training, iterated graph scores and Viterbi paths are not expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, docs = Stage(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = keep.write(stage(spark, docs, sf_dir), name)
        if k:
            keep.drop(STAGES[k - 1][0])
    return docs
