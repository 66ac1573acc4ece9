"""The corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; its result is
written as Parquet in the shared folder and read again, so a lost executor costs at most
a stage. All but the last return the columns of documents.

1. language_id: documents that no language can be given (no letter in the text) go.
2. exact_dedup: of equal texts the largest doc_id stays.
3. simhash_dedup: of near duplicates the smallest doc_id stays.
4. decontaminate: documents with benchmark passages in a twentieth of their words go.
5. packing: documents to sequences of 2048 tokens, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from careline.llm import decontaminate, exact, langid, packing, simhash
from careline.llm.common import read, written
from careline.llm.q_tokens import files


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_known_language(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, files())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

#: SQL cannot express the random field, the fingerprints' components or the packing; the stages are
#: held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass the stages."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
