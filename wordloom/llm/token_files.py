"""Token ids as Parquet files with list columns, ordered by document id.

The ids of a document are one list value. Spark's Parquet writer gets the encoding (a dictionary of
token ids, or delta-packed integers), the size of row groups and the rows of a page, and writes page
indexes, so that a reader can fetch the tokens of a few documents, or the metadata alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import id_type, keyed_text, map_batches
from wordloom.llm.tokenizing import encoder, encoder_key, text_blocks

ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 256


def tokenized(rows: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """``id, n_tokens, tokens`` of ``id, text``; null texts count as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            for block in text_blocks(texts):
                ids, starts = encode(texts[block.start : block.stop], end)
                tokens = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view(np.int32)))
                columns = [batch.column(0).slice(block.start, len(block)), pa.array(np.diff(starts)), tokens]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "tokens"])

    return map_batches(rows, work, f"id {id_type(rows)}, n_tokens bigint, tokens array<int>", encoder_key(tokenizer))


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write ``place, doc_id, n_tokens, tokens`` in ascending order of the ids, over all files.

    ``place`` grows by one from row to row of a file; its upper 31 bits are the file's number.

    ``encoding``: ``dictionary`` (ids as bit-packed places in a dictionary per row group) or ``delta``
    (delta-packed integers). ``end`` closes each document. Null texts hold the end id only, null ids come
    first, rows of one id stand in the order of their texts; other columns are not read. An empty table
    gives a folder that reads as an empty table. Ranges of (id, text hash) split an id that many rows share.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    rows = keyed_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    files = max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(files, "id", "hash").sortWithinPartitions("id", "hash", "text")
    made = tokenized(ordered.select("id", "text"), tokenizer, end).select(F.monotonically_increasing_id().alias("place"), F.col("id").alias("doc_id"), "n_tokens", "tokens")
    writer = made.write.mode("overwrite")
    settings = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(4 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }
    for key, value in settings.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``write_token_files``; a selection of columns or ids reads only their pages."""
    return spark.read.parquet(path)


def checksums(files: DataFrame) -> DataFrame:
    """``place, doc_id, n_tokens, ids_crc32``: CRC-32 of each document's ids as little-endian 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            cuts = tokens.offsets.to_numpy().astype(np.int64) * 4
            data = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            counts = pa.array(np.diff(cuts) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(sums, pa.int64())], names=["place", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.select("place", "doc_id", "n_tokens", "tokens")
    return map_batches(rows, work, f"place bigint, doc_id {id_type(files, 'doc_id')}, n_tokens bigint, ids_crc32 bigint")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all documents before, in the order of the files.

    Each file's tokens are summed first, so that only one small row per file is ordered in one place.
    """
    rows = rows.withColumn("shard", F.shiftright("place", 33))
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return placed.join(before, "shard").withColumn("start", F.col("upto") + F.col("before")).drop("upto", "before", "shard")
