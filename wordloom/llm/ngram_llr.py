"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio.

Words and runs of signs, and their pairs, are hashed to a fixed number of bins. Two multinomials are
counted: over the whole corpus, and over the documents that are trusted. A document's ratio is the
mean over its n-grams of the log of how much more often the trusted documents hold the bin than the
corpus lets expect. All of it is built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import keyed_text, made_once, pick
from wordloom.session import stage

BINS = 1 << 14
BROADCAST_BYTES = 16 << 20  # trusted ids that may be broadcast after their bytes were counted, 8 and their characters each
PRIOR = 5.0  # n-grams added to observed and expected counts of a bin
THRESHOLD = -0.3  # junk lies below -0.8, good texts above -0.1
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOL = "[#*$%&|<>]"
_PIECE = r"[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]+"


def _long(value: Column, name: str) -> Column:
    return value.cast("long").alias(name)


def with_base_rules(rows: DataFrame) -> DataFrame:
    """``id, text`` to ``id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Words are compared by the 64-bit hash of five in a row. The columns in between are made once per row:
    a step that is used several times is a projection of its own. No step goes through a text sign by sign (``translate``)
    or copies a window.
    """
    text = F.coalesce("text", F.lit(""))
    cut = rows.select(
        "id",
        text.alias("text"),
        F.array_remove(F.split(text, "[ \\t\\n\\x0b\\f\\r]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(_SPACE)) != "").alias("lines"),
    )
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    grams = F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    counted = cut.select(
        "id",
        "text",
        _long(n, "n_words"),
        _long(F.char_length(F.array_join("words", "")), "word_chars"),
        _long(F.regexp_count("text", F.lit(_SYMBOL)), "n_symbols"),
        _long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        grams.alias("grams"),
    )
    kept = ["id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # Windows next to each other by hash, where any two are equal.
    placed = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("gram"), i.alias("at"))))
    none = F.array().cast("array<struct<gram:bigint,at:int>>")
    ordered = counted.select(*kept, F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed).otherwise(none).alias("ordered"))
    size = F.size("ordered")
    like_next = F.zip_with("ordered", F.slice("ordered", 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.coalesce(a["gram"] == b["gram"], F.lit(False)))
    marked = ordered.select(*kept, "ordered", like_next.alias("like_next"))
    like_last = F.concat(F.array(F.lit(False)), F.col("like_next"))
    found = F.zip_with(F.zip_with("ordered", "like_next", lambda a, b: F.struct(a["at"].alias("at"), b.alias("yes"))), like_last, lambda a, b: F.when(a["yes"] | b, a["at"]))
    starts = marked.select(*kept, F.array_sort(F.array_compact(found)).alias("starts"))
    covered = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = starts.select(*kept, _long(F.aggregate(covered, F.lit(0), lambda x, y: x + y), "n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return repeated.withColumn("base_failed", failed)


def with_bins(rows: DataFrame, text: str, bins: int) -> DataFrame:
    """Add ``bins``: the bin of every word or run of signs, then of every pair of neighbours."""
    names = rows.columns
    pieces = rows.select(*names, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0)).alias("pieces"))
    pairs = F.zip_with("pieces", F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(bins)).cast("int")))
    single = F.transform("pieces", lambda a: F.pmod(F.xxhash64(a), F.lit(bins)).cast("int"))
    return pieces.select(*names, F.concat(single, F.array_compact(pairs)).alias("bins"))


def count_bins(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trusted_id_col: str = "doc_id",
    bins: int = BINS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``bin, n, n_trusted``: n-grams of all documents, and of those whose ids are in ``trusted``.

    The corpus and the trusted documents are counted whole. The trusted ids are broadcast where their counted size is within
    ``broadcast_bytes``, so no text is shuffled; a longer list meets the texts in a shuffle, without the rows that have no
    id. Null ids are never trusted. Each task adds up its bins before the shuffle, so it sends ``bins`` rows at most.
    """
    rows = keyed_text(docs, id_col, text_col)
    ids = stage(pick(trusted, of=trusted_id_col).where("of is not null").distinct(), "trusted")
    size = ids.agg(F.sum(F.octet_length(F.col("of").cast("string")) + 8)).first()[0] or 0
    is_trusted = F.col("of").isNotNull().cast("int").alias("is_trusted")
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(ids), F.col("id") == F.col("of"), "left").select("text", is_trusted)
    else:
        named = rows.where("id is not null").join(ids, F.col("id") == F.col("of"), "left").select("text", is_trusted)
        joined = named.unionByName(rows.where("id is null").select("text", F.lit(0).alias("is_trusted")))
    # With a plain explode Spark would cut the texts once more below the join, to leave out those without n-grams.
    grams = with_bins(joined, "text", bins).select("is_trusted", F.explode_outer("bins").alias("bin"))
    counts = grams.groupBy("bin").agg(F.count("*").alias("n"), F.sum("is_trusted").cast("long").alias("n_trusted"))
    return counts.where("bin is not null")


def bin_weights(counts: DataFrame, bins: int = BINS, prior: float = PRIOR) -> list[float]:
    """The log ratio of every bin, rounded so that sums do not depend on its last digits. ``bins`` bounds what is collected."""
    found = {r["bin"]: (r["n"], r["n_trusted"]) for r in counts.collect()}
    total, trusted = sum(n for n, _ in found.values()), sum(t for _, t in found.values())
    weights = [0.0] * bins
    for at, (n, t) in found.items():
        expected = n * trusted / max(total, 1)
        weights[at] = round(math.log((t + prior) / (expected + prior)), 6) if trusted else 0.0
    return weights


def mean_ratio(bins: str, weights: list[float]) -> Column:
    """Mean weight of a row's bins; 0 without n-grams."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(bins, F.lit(0.0), lambda x, b: x + F.get(table, b))
    return total / F.greatest(F.size(bins), F.lit(1))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trusted_id_col: str = "doc_id",
    bins: int = BINS,
    prior: float = PRIOR,
    threshold: float = THRESHOLD,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept``.

    One row per document. ``kept``: the base rules hold and ``ratio`` is at least ``threshold``; a tie is kept. Null and
    empty texts fail the base rules; without trusted documents every ratio is 0; repeated rows get the same result;
    an empty table gives no rows; texts of any length are read whole; other columns are not read.
    """
    weights = bin_weights(count_bins(docs, trusted, id_col, text_col, trusted_id_col, bins, broadcast_bytes), bins, prior)
    rows = keyed_text(docs, id_col, text_col)
    ruled = with_bins(with_base_rules(rows), "text", bins)
    scored = ruled.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", mean_ratio("bins", weights).alias("ratio"))
    judged = scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    return made_once(judged, *judged.columns[1:])
