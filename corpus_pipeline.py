"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage reads all that its predecessor kept, written as Parquet in between, and
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepwise.llm import minhash_cps, mixing, packing, pii
from keepwise.llm import quality_rules as quality
from keepwise.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    return quality.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash_cps.drop_near_duplicates(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets where personal data stood."""
    return pii.masked(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and cut into full sequences, one row per piece with its ids."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]
#: Minwise trees, mixing permutations and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
