"""Subtitles to deck words, and word lists to request lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import capitalise
from wordloom.operators.packing import pack_words, split_valid_word_lists
from wordloom.operators.requests import build_requests
from wordloom.operators.subtitles import remove_words, text_words
from wordloom.schemas import DEFAULT_WORDS_PER_REQUEST, MAX_REQUESTS
from wordloom.session import stage


def deck_words(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """The distinct new words of each subtitle text, capitalised, ``rank`` in first-seen order.

    ``known`` holds the words to leave out. While that list is small enough to broadcast, the
    whole plan is one pass over the texts without a shuffle.
    """
    new = remove_words(text_words(texts, text), known)
    return new.withColumn("word", capitalise(F.col("word")))


def word_list_requests(
    words: DataFrame,
    words_per_request: int = DEFAULT_WORDS_PER_REQUEST,
    requests_per_batch: int = MAX_REQUESTS,
    **request_options,
) -> DataFrame:
    """Request lines of word list files (``read_word_list``), ready for ``write_requests``."""
    packed = pack_words(
        stage(words, "word-list"),
        order=["line_id"],
        words_per_request=words_per_request,
        requests_per_batch=requests_per_batch,
        chunk=F.col("block"),
    )
    return build_requests(packed, **request_options)


def nested_requests(
    rows: DataFrame, by: Sequence[str], lists: str = "word_list", mode: str = "structured", **request_options
) -> tuple[DataFrame, DataFrame]:
    """Request lines of nested word lists, and the rows whose lists are refused.

    A row is one batch: ``by`` names it, and each of its inner lists is a request, in their order. Columns of the
    lines: ``by``, ``batch_id`` (0), ``request_id``, ``words`` and those of ``build_requests``.
    """
    valid, refused = split_valid_word_lists(rows, lists)
    packed = valid.select(
        *by, F.lit(0).cast("bigint").alias("batch_id"), F.posexplode(lists).alias("request_id", "words")
    ).withColumn("request_id", F.col("request_id").cast("bigint"))
    return build_requests(packed, mode, **request_options), refused
