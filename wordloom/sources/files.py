"""Readers. Line readers keep the file order in ``(block, line_id)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import WHITE, has_ink, strip_white
from wordloom.operators.ordering import dense_positions
from wordloom.operators.results import parse_lines

# Items of a document's list that are numbered together.
ITEMS_PER_BLOCK = 65_536


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path``, ``text``."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def source_name(path: Column | None = None) -> Column:
    """The file name and a hash of the whole path, so that files of the same name in two folders
    stay apart and the name still fits a partition folder."""
    path = F.regexp_replace(F.col("_metadata.file_path") if path is None else path, "^file:/+", "file:/")
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lower(F.hex(F.xxhash64(path))))


def line_columns(lines: DataFrame) -> DataFrame:
    """``source``, ``block``, ``line`` of a text read, batch or stream."""
    return lines.select(
        source_name().alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def list_sources(spark: SparkSession, path: str) -> DataFrame:
    """``source_batch`` of every file, also of those without a byte, which Spark's readers pass over."""
    files = [(name,) for name in _binary_files(spark, path).inputFiles()]
    return spark.createDataFrame(files, "file STRING").select(source_name(F.col("file")).alias("source_batch"))


def empty_sources(spark: SparkSession, path: str) -> DataFrame:
    """``source_batch`` of the files without a byte."""
    named = list_sources(spark, path)
    filled = _binary_files(spark, path).select(source_name().alias("source_batch"))
    return named.join(filled, "source_batch", "left_anti")


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_id``, which grows along a block. Call it before any shuffle of the lines."""
    return lines.withColumn("line_id", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines that end at ``\\n`` only: ``source``, ``block``, ``line``, ``line_id``."""
    return number_lines(line_columns(spark.read.text(path, lineSep="\n")))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Word list lines, LF or CRLF, without blank ones; edge spaces stay."""
    lines = read_lines(spark, path).withColumn("word", F.regexp_replace("line", r"\r\z", ""))
    return lines.filter(has_ink(F.col("word"))).select("source", "block", "line_id", "word")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of result or error files, without blank ones and byte order marks."""
    return json_lines(read_lines(spark, path))


def json_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", r"^\x{FEFF}", "")).filter(
        has_ink(F.col("line"))
    )


def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole ``{results, errors}`` documents: ``source``, ``value`` (VARIANT), ``raw``.

    ``value`` is NULL where the file is not exactly one JSON value.
    """
    files = _binary_files(spark, path).select(source_name().alias("source"), "content")
    texts = files.select("source", F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}", "").alias("raw"))
    empty = empty_sources(spark, path).select(F.col("source_batch").alias("source"), F.lit("").alias("raw"))
    texts = texts.unionByName(empty)
    return parse_lines(texts, "raw")


def document_rows(documents: DataFrame, name: str) -> DataFrame:
    """``source``, ``block``, ``line_id`` (place in the list), ``value`` of the list ``name``."""
    items = F.try_variant_get("value", f"$.{name}", "array<variant>")
    listed = documents.select("source", F.posexplode(items).alias("at", "value"))
    place = F.col("at").cast("bigint")
    block = F.expr(f"at div {ITEMS_PER_BLOCK}").cast("bigint")
    return listed.select("source", block.alias("block"), place.alias("line_id"), "value")


def unread_documents(documents: DataFrame) -> DataFrame:
    """``source_batch``, ``stage``, ``reason``, ``line`` of documents, and lists in them, that can't be read."""
    value = F.col("value")

    def no_list(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        return F.coalesce(~kind.startswith("ARRAY") & (kind != "VOID"), F.lit(False))

    reasons = F.array_compact(
        F.when(value.isNull(), F.array(F.lit("malformed document"))).otherwise(
            F.array(
                F.when(~F.schema_of_variant(value).startswith("OBJECT"), F.lit("no document")),
                F.when(no_list("results"), F.lit("results are no list")),
                F.when(no_list("errors"), F.lit("errors are no list")),
            )
        )
    )
    return documents.select(
        F.col("source").alias("source_batch"),
        F.lit("document").alias("stage"),
        F.explode(reasons).alias("reason"),
        strip_white(F.col("raw")).alias("line"),
    )


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """Language names, trimmed, without blank ones, numbered from 1 in file order."""
    names = read_lines(spark, path).withColumn(
        "name", F.regexp_replace("line", rf"^[{WHITE}]+|[{WHITE}]+\z", "")
    )
    named = names.filter(F.col("name") != "")
    numbered = dense_positions(
        named, ["block", "line_id"], ["source"], name="_index", chunk=F.col("block")
    )
    return numbered.select((F.col("_index") + 1).cast("int").alias("id"), "name")
