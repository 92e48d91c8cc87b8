"""All documents as token files, read back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import read_table
from wordloom.llm.token_files import checksums, read_token_files, with_starts, write_token_files
from wordloom.session import stage, staged_path

END_ID = 2


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    read = stage(checksums(read_token_files(spark, path)), "token-sums")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
