"""Secrets in all documents."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read_table
from wordloom.llm.token_efficiency import scan_secrets, spans_text


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        _count("assign"),
        _count("access"),
        _count("hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
