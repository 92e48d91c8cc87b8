"""Subtitle texts to words: tokens, distinct words, removal of known words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import (
    capitalise,
    clean_subtitle,
    distinct_lower_words,
    has_ink,
    keep_word_characters,
    split_words,
)
from wordloom.operators.lookups import drop_listed

# Fixed values of a packed BIGINT and INT: beyond all values of an INT, and what stands for a missing BIGINT.
STEP = 1 << 33
NO_BIGINT = "-9223372036854775809"


def subtitle_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per token: the other columns, ``pos`` from 0, ``token``. Narrow, no shuffle.

    A text that starts or ends with white space after cleaning gives an empty token there, and
    so does an empty text.
    """
    others = [name for name in texts.columns if name != text]
    tokens = split_words(clean_subtitle(F.col(text)))
    return texts.select(*others, F.posexplode(tokens).alias("pos", "token"))


def distinct_words(
    tokens: DataFrame, order: Sequence[str], scope: Sequence[str] = (), token: str = "token"
) -> DataFrame:
    """The distinct words per scope, ignoring case, each with the ``order`` of its first token.

    Columns: ``scope``, ``word`` (capitalised), ``order``. Sort by ``order`` for the first-seen
    sequence. The first tokens are found before the shuffle, so a frequent word, or a scope with
    most of the rows, reaches the shuffle once per task.
    """
    scope, order = list(scope), list(order)
    inked = tokens.filter(has_ink(F.col(token)))
    keys = [*scope, F.lower(F.col(token)).alias("_lower")]
    kinds = [tokens.schema[name].dataType.simpleString() for name in order]
    word = capitalise(F.col("_lower")).alias("word")
    if kinds != ["bigint", "int"]:
        first = inked.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
        return first.select(*scope, word, "_first.*")
    first = inked.groupBy(*keys).agg(F.min(_packed(*order)).alias("_first"))
    return first.select(*scope, word, *_unpacked(order))


def _packed(high: str, low: str) -> Column:
    """A BIGINT and an INT as one number in the order of both, nulls first.

    The least number of a word is kept in a hash map, which holds each word once; for structs Spark sorts all rows of a task.
    """
    first = F.coalesce(F.col(high).cast("decimal(20,0)"), F.lit(NO_BIGINT).cast("decimal(20,0)"))
    second = F.coalesce(F.col(low).cast("bigint") + (1 << 31) + 1, F.lit(0).cast("bigint"))
    return first * F.lit(STEP).cast("decimal(10,0)") + second.cast("decimal(10,0)")


def _unpacked(order: Sequence[str]) -> list[Column]:
    rest = F.expr(f"pmod(_first, CAST({STEP} AS DECIMAL(10, 0)))")
    whole = F.expr(f"(_first - pmod(_first, CAST({STEP} AS DECIMAL(10, 0)))) div CAST({STEP} AS DECIMAL(10, 0))")
    high = F.when(F.col("_first") >= F.lit(-(1 << 63)).cast("decimal(32,0)") * F.lit(STEP).cast("decimal(10,0)"), whole)
    low = F.when(rest > 0, (rest.cast("bigint") - (1 << 31) - 1).cast("int"))
    return [high.alias(order[0]), low.alias(order[1])]


def text_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """The distinct lower-case words of each subtitle text, ``rank`` in first-seen order.

    Same as :func:`distinct_words` with one text as the scope, but inside the row: no shuffle.
    """
    return _exploded(texts, text, clean_subtitle(F.col(text)))


def _exploded(texts: DataFrame, text: str, cleaned: Column) -> DataFrame:
    others = [name for name in texts.columns if name != text]
    words = distinct_lower_words(cleaned)
    return texts.select(*others, F.posexplode(words).alias("rank", "word"))


def corpus_words(
    texts: DataFrame,
    order: Sequence[str],
    scope: Sequence[str] = (),
    text: str = "text",
    subtitles: bool = True,
) -> DataFrame:
    """The distinct words of all texts of a scope, ignoring case, each with its first place.

    Same as :func:`distinct_words` over the tokens of the texts, which are in ``order``: columns
    ``scope``, ``word`` (capitalised), ``order``, ``rank`` in its text. The words of a text are
    made distinct inside its row, so that far fewer rows are aggregated and shuffled.
    """
    clean = clean_subtitle if subtitles else keep_word_characters
    words = _exploded(texts.select(*scope, *order, text), text, clean(F.col(text)))
    return distinct_words(words, [*order, "rank"], scope, "word")


def remove_words(words: DataFrame, known: DataFrame, word: str = "word", **limits: int) -> DataFrame:
    """Drop the words in the one column of ``known``, ignoring case on both sides; ``limits`` as in ``drop_listed``."""
    name = known.columns[0]
    return drop_listed(words, F.lower(F.col(word)), known.select(F.lower(name).alias(name)), **limits)
