"""From raw documents to packed training sequences in five stages.

Each stage reads what its predecessor kept; all but the last return the columns
of ``documents``, the last one row per packed piece. Near-duplicates, passages
and copies are therefore judged on documents that passed the rules before.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memoria.llm import mixing, neardup, packing, quality, repeats
from memoria.llm.common import materialize
from memoria.sources.tables import Tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's rules reject go."""
    return quality.keep_good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class stays: that of the smallest doc_id."""
    return neardup.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that an earlier document holds are cut from the text."""
    return repeats.strip_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them: no row, one, or two with the same doc_id."""
    return mixing.repeat_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicates_stage),
    ("repeated passages", repeats_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

# signatures, the tilt and the tokenizer have no SQL; tests hold the run against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared folder and read back."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
