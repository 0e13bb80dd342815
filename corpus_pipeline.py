"""A training corpus from raw documents: language, exact and near copies, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as
Parquet and read again before the next.  All but the last return the columns they got; mixing adds
shard and place (under other names where docs has columns so named).  Rows are told apart by their
texts, so rows without an id take part in all stages, and rows that repeat an id with another text are
documents of their own.  Only rows that are alike in every column count as one, from the second stage
on.  Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import unique_documents
from tidemark.llm.language_id import accepted, sample, train
from tidemark.llm.mixing import take
from tidemark.llm.near_dedup import unlike_documents
from tidemark.llm.packing import pack
from tidemark.llm.runtime import documents, materialise
from tidemark.llm.tokens import default_tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject: some letters, and a cross-entropy that a known language shows."""
    return accepted(docs, train(sample(docs, "doc_id", "text", "lang")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, of these the one with the least id."""
    return unique_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near duplicates; texts without words stay."""
    return unlike_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, dealt into shards and shuffled within each."""
    return take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return pack(docs, default_tokenizer())


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixture), ("packing", packed)]

#: Language models, signatures, hashed draws and tokens can't be expressed in SQL; tests/llm/test_pipeline.py
#: holds each stage, and the whole, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
