"""Training-data pipeline over the documents: its stages, in order.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next stage's
documents. All but the last return the columns of ``documents``. Null and empty texts are scored as empty by the first
stage, pass the others as they are and are packed as the end id alone; a stage without rows gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import read_table
from wordloom.llm.decontamination import clean_documents
from wordloom.llm.parity_join import one_per_class
from wordloom.llm.rule_ensemble import keep_good, train_quality_rules
from wordloom.llm.token_efficiency import redact_documents
from wordloom.llm.vector_packing import pack_documents
from wordloom.session import stage

QUALITY_THRESHOLD = 0.3
END_ID = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is fitted on labelled rows of these documents."""
    return keep_good(docs, train_quality_rules(docs, read_table(spark, sf_dir, "labels")), QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id."""
    return one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``benchmark``; a document of which nothing is left goes."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets redacted."""
    return redact_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences, with their token ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Trained rules, tokenizers and packing have no SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result staged as Parquet in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)
