"""Word entries to processed words: useless ones dropped, similar words near by, categories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.words import (
    all_translations,
    filled_categories,
    is_translated,
    within_distance,
)
from wordloom.operators.alike import similar_rows
from wordloom.schemas import DEFAULT_DISTANCE, DEFAULT_NEIGHBOURS

# Width of a cell of neighbours: this many times their reach, and at least so many places.
CELL_FRAMES = 16
LEAST_CELL = 8
# Cells are dealt to this many tasks per core.
TASKS_PER_CORE = 8


def drop_untranslated(entries: DataFrame) -> DataFrame:
    """Keep entries with a translation that differs from the word."""
    return entries.filter(is_translated(F.col("word"), F.col("translations")))


def _sketched(text: Column) -> Column:
    """A text in lower case, and a bit for each letter that it holds an odd number of times.

    An edit turns over two bits at most, so texts within a distance differ in at most twice as many bits.
    """
    lower = F.lower(text)
    letters = F.split(lower, "")
    bits = F.aggregate(letters, F.lit(0).cast("long"), lambda total, each: total.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(each) % 64)))
    return F.struct(lower.alias("text"), bits.alias("bits"))


def _alike(left: Column, right: Column, distance: int) -> Column:
    """Whether two sketched texts are within ``distance``; most pairs end at the bits, equal texts before."""
    near = F.bit_count(left["bits"].bitwiseXOR(right["bits"])) <= 2 * distance
    return (left["text"] == right["text"]) | (near & within_distance(left["text"], right["text"], distance))


def _looked(entries: DataFrame, distance: int, neighbours: int, sequence: str, pos: str, give: str | None) -> DataFrame:
    """``row`` of the translated entries, and ``found``: column ``give`` of those alike to each, in the order of their places.

    Without ``give``, how many places each is away.

    Sequences are cut into cells many times ``neighbours`` wide. Entries near the edges of a cell are copied to the
    cells beside it, so each entry meets all that it can see in its own cell: one exchange of the bare entries, and no
    join back. What is compared is read from them behind it. A cell is ordered and compared in the workers, some cells
    at a time (:mod:`wordloom.operators.alike`). Likeness holds both ways, so each pair is compared once. Bare entries
    are few bytes and much work, so the cells are dealt to many tasks whatever their bytes.
    """
    if distance < 0 or neighbours < 0:
        raise ValueError("distance and neighbours must not be negative")
    width = max(CELL_FRAMES * neighbours, LEAST_CELL)
    bare = entries.select(F.struct(*(F.col(name) for name in entries.columns)).alias("row"))
    line, at = F.col("row").getField(sequence), F.col("row").getField(pos).cast("bigint")
    cell, place = F.floor(at / F.lit(width)), F.pmod(at, F.lit(width))
    beside = F.array_compact(
        F.array(F.lit(0), F.when(place < neighbours, F.lit(-1)), F.when(place >= width - neighbours, F.lit(1)))
    )
    dealt = bare.select("row", F.explode(F.transform(beside, lambda moved: cell + moved)).alias("cell"))
    tasks = TASKS_PER_CORE * entries.sparkSession.sparkContext.defaultParallelism
    # Only the entry and its cell are sent; the rest is read from them again.
    gathered = dealt.repartition(tasks, line, "cell").select(line.alias("sequence"), "cell", at.alias("at"), "row", cell.alias("home"))
    ordered = gathered.sortWithinPartitions("sequence", "cell", "at")
    word, listed = F.col("row.word"), all_translations(F.col("row.translations"))
    read = ordered.select("*", word.alias("word"), listed.alias("listed"))
    looks = F.coalesce(F.exists("listed", lambda each: each != F.col("word")), F.lit(False))
    sent = read.select(
        "sequence",
        "cell",
        "at",
        # Only its own cell gives an entry back, when it looks around.
        (F.col("cell").eqNullSafe(F.col("home")) & looks).alias("asks"),
        F.lower("word").alias("spelled"),
        F.array_distinct(F.transform("listed", F.lower)).alias("meanings"),
        "row",
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return similar_rows(batches, distance, neighbours, give)

    found = T.ArrayType(entries.schema[give].dataType if give else T.IntegerType())
    return sent.mapInArrow(work, T.StructType([bare.schema["row"], T.StructField("found", found)]))


def process_words(
    entries: DataFrame,
    distance: int = DEFAULT_DISTANCE,
    neighbours: int = DEFAULT_NEIGHBOURS,
    sequence: str = "source_batch",
    pos: str = "pos",
    as_steps: bool = False,
) -> DataFrame:
    """Translated entries with ``similar_words`` and ``grammar_categories``; other columns stay.

    Similar words are those at most ``neighbours`` places away that are alike by spelling or by a translation. They come
    in the order of their places, repeats included. ``(sequence, pos)`` is unique and ``pos`` dense over all entries, the
    untranslated ones included: those are found but do not look. With ``as_steps`` there are ``similar_steps`` instead of
    ``similar_words``: how many places each of them is away, so that no word is repeated.
    """
    name = "similar_steps" if as_steps else "similar_words"
    found = _looked(entries, distance, neighbours, sequence, pos, None if as_steps else "word")
    return found.select("row.*", F.col("found").alias(name)).select(
        *(F.col(column) for column in entries.columns),
        name,
        filled_categories(F.col("translations")).alias("grammar_categories"),
    )
