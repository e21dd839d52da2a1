"""The corpus pipeline: language, exact copies, near copies, benchmark passages, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
moves no text but where copies are dropped. The first four return the columns of
``docs``; the last returns one row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandpanel.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from demandpanel.llm.base import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; others, such as noise and languages not learned, go."""
    return language_id.identified(docs, language_id.train(docs))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def first_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 of 100 five-word shingles."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", first_copies),
    ("MinHash near-dedup", first_of_alike),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]
#: The stages hold trained models, signatures and tokens, which SQL cannot say; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
