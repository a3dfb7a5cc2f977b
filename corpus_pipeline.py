"""A training corpus from raw documents, stage by stage.

Each stage takes the table that the one before it has written and works on all of it: quality rules,
toxicity, one document of each group of near-duplicates, the mixture of sources, and encoding. Rows
that a stage turns down go; the mixture repeats a document as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimsweep.llm import mixing, pieces, quality, simhash, toxicity
from claimsweep.llm.common import read_table
from claimsweep.staging import stage

# SQL cannot express the network, the fingerprints' hash or the lattice search: see tests/llm/test_pipeline.py
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, score, others, round_trip)``: the corpus as piece ids, with the next best segmentations."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sentencepiece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
