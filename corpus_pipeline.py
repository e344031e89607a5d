"""Quality rules, near-duplicates, repeated passages, benchmark leaks and packing, over documents.

Each stage is its operator on what the stage before has kept, and all but the last return the columns of documents.
Defined results: a document with a null or blank text is rejected by the quality rules; of rows that are near copies of
each other one stays, repeated rows and those without doc_id included; a text of which nothing is left goes; no
documents give no sequences, and no benchmark rejects none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontam, nearcopies, packing, passages, quality
from ledgerloom.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.representatives(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.cleaned_documents(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_copies),
    ("repeated passages", drop_repeats),
    ("benchmark leaks", drop_leaks),
    ("packing", pack_sequences),
]

#: Expectation-maximisation, shingle fingerprints and a tokenizer can't be said in SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
