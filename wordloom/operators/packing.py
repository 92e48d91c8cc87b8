"""Word lists to requests and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import has_ink
from wordloom.operators.ordering import dense_positions
from wordloom.schemas import DEFAULT_WORDS_PER_REQUEST, MAX_REQUESTS


def _require_positive(**sizes: int) -> None:
    for name, size in sizes.items():
        if size < 1:
            raise ValueError(f"{name} must be at least 1, got {size}")


def assign_requests(
    words: DataFrame,
    pos: str = "pos",
    words_per_request: int = DEFAULT_WORDS_PER_REQUEST,
    requests_per_batch: int = MAX_REQUESTS,
) -> DataFrame:
    """Add ``batch_id``, ``request_id`` (from 0 in its batch) and ``slot`` from a dense position."""
    _require_positive(words_per_request=words_per_request, requests_per_batch=requests_per_batch)
    place = F.col(pos).cast("bigint")
    request = F.expr(f"`{pos}` div {words_per_request}")
    return words.select(
        "*",
        F.expr(f"(`{pos}` div {words_per_request}) div {requests_per_batch}").alias("batch_id"),
        F.pmod(request, F.lit(requests_per_batch)).cast("bigint").alias("request_id"),
        F.pmod(place, F.lit(words_per_request)).cast("int").alias("slot"),
    )


def pack_words(
    words: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = ("source",),
    word: str = "word",
    words_per_request: int = DEFAULT_WORDS_PER_REQUEST,
    requests_per_batch: int = MAX_REQUESTS,
    chunk: Column | None = None,
) -> DataFrame:
    """Pack each source's words, in order, into requests and the requests into batches.

    One row per request: ``by``, ``batch_id``, ``request_id``, ``words``. The last request and
    the last batch of a source may be short. At most ``words_per_request`` rows meet in a group.
    """
    numbered = dense_positions(words, order, by, chunk=chunk)
    placed = assign_requests(numbered, "pos", words_per_request, requests_per_batch)
    return _gather(placed, [*by, "batch_id", "request_id"], word, "words")


def chunk_rows(
    rows: DataFrame,
    value: str,
    size: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    chunk: Column | None = None,
) -> DataFrame:
    """Cut each group's rows, in order, into pieces of ``size``: ``by``, ``chunk_id``, ``items``."""
    _require_positive(size=size)
    numbered = dense_positions(rows, order, by, name="_pos", chunk=chunk)
    placed = numbered.select(
        *by,
        F.col(value),
        F.expr(f"_pos div {size}").alias("chunk_id"),
        F.pmod("_pos", F.lit(size)).cast("int").alias("slot"),
    )
    return _gather(placed, [*by, "chunk_id"], value, "items")


def _gather(placed: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("slot", F.col(value).alias("item"))))
    return placed.groupBy(*keys).agg(items.alias("_items")).select(
        *keys, F.col("_items.item").alias(name)
    )


def chunk_array(items: Column, size: int) -> Column:
    """The array of a row cut into arrays of ``size``; the last one may be short."""
    _require_positive(size=size)
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size)),
        lambda start: start <= F.size(items),
    )
    return F.transform(starts, lambda start: F.slice(items, start, F.lit(size)))


def valid_word_lists(lists: Column) -> Column:
    """True for a non-empty list of non-empty lists of non-blank strings; never NULL."""
    filled = F.forall(
        lists,
        lambda each: F.coalesce(
            (F.size(each) > 0) & F.forall(each, lambda s: F.coalesce(has_ink(s), F.lit(False))),
            F.lit(False),
        ),
    )
    return F.coalesce((F.size(lists) > 0) & filled, F.lit(False))


def split_valid_word_lists(df: DataFrame, lists: str = "word_list") -> tuple[DataFrame, DataFrame]:
    """The rows with a valid nested word list, and the rejected ones."""
    valid = valid_word_lists(F.col(lists))
    return df.filter(valid), df.filter(~valid)
