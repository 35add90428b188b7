"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again.

All stages but the last return the columns of documents. Quality rules drop rejected texts, near-dedup keeps
one document of each group, decontamination drops documents with benchmark items, personal data becomes
pseudonyms in the text, and the last stage gives each text's n best segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import common, fertility, near_dup, pieces, pii, templates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.kept_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("pseudonyms", pseudonyms), ("encoding", encoding),
]

#: The stages use compiled tokenizers, sketches and keyed permutations, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
