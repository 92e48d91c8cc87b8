"""Result files to the dictionary: parse, route, enrich, store."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.words import known_category
from wordloom.operators.enrich import drop_untranslated, process_words
from wordloom.operators.results import (
    entry_rows,
    error_rows,
    parse_lines,
    quarantine_rows,
    route_errors,
    route_results,
    word_entries,
)
from wordloom.plans.dictionary import save_dictionary
from wordloom.schemas import DEFAULT_DISTANCE, DEFAULT_NEIGHBOURS, ENGLISH, GERMAN
from wordloom.session import LONG_ROWS, stage, temporary_stages
from wordloom.sources.files import document_rows, unread_documents
from wordloom.sources.sinks import replace_batches

RESULT, ERROR = "result", "error"


class Words(NamedTuple):
    """What result lines hold: processed words, errors and refusals, what can't be used, and all entries."""

    processed: DataFrame
    errors: DataFrame
    aside: DataFrame
    entries: DataFrame


def _parsed(lines: DataFrame) -> DataFrame:
    return lines if "value" in lines.columns else parse_lines(lines)


def _batches(parsed: DataFrame, more: DataFrame | None) -> DataFrame:
    """Every file of the run, with lines that count or not."""
    found = parsed.select(F.col("source").alias("source_batch"))
    return (found if more is None else found.unionByName(more.select("source_batch"))).distinct()


def result_words(
    lines: DataFrame,
    distance: int = DEFAULT_DISTANCE,
    neighbours: int = DEFAULT_NEIGHBOURS,
    unknown_categories: str = "raise",
    as_steps: bool = False,
) -> Words:
    """The words of result lines, their errors and what has to be set aside; stores nothing.

    ``lines`` comes from ``read_json_lines``, or from ``document_rows``, which is parsed already. A file
    is a source batch: similar words never cross files. With ``unknown_categories="quarantine"`` entries
    with an unknown category are set aside, after they have taken part as neighbours. ``as_steps`` gives similar
    words as places (:func:`process_words`), which ``entries`` tell.
    """
    if unknown_categories not in ("raise", "quarantine"):
        raise ValueError("unknown_categories must be 'raise' or 'quarantine'")
    # Parsed once; the words, errors and set-aside rows below read this table.
    routed = stage(route_results(_parsed(lines)), "routed", compression="zstd", **LONG_ROWS)
    entries = stage(entry_rows(routed), "entry-rows")
    numbered = stage(word_entries(routed, entries), "entries")
    processed = process_words(numbered, distance, neighbours, as_steps=as_steps)
    aside = quarantine_rows(routed, entries)
    if unknown_categories == "quarantine":
        usable = F.forall(F.map_keys("translations"), known_category)
        # What looks for similar words is known before they are found.
        strange = drop_untranslated(numbered).filter(~usable).select(
            "source_batch",
            F.lit("category").alias("stage"),
            F.lit("unknown category").alias("reason"),
            F.to_json(F.struct("word", "translations")).alias("line"),
        )
        aside, processed = aside.unionByName(strange), processed.filter(usable)
    return Words(processed, error_rows(routed), aside, numbered)


def ingest_results(
    lines: DataFrame,
    root: str,
    distance: int = DEFAULT_DISTANCE,
    neighbours: int = DEFAULT_NEIGHBOURS,
    primary_language: int = GERMAN,
    secondary_language: int = ENGLISH,
    unknown_categories: str = "raise",
    batches: DataFrame | None = None,
) -> None:
    """Store the words of result files, their error rows and what had to be set aside.

    See :func:`result_words`. Storing a file again replaces what it stored before; ``batches``
    (``list_sources``) names the files of the run, so that one that lost all its lines counts too.
    What error files stored for the same source batch stays.
    """
    with temporary_stages(lines.sparkSession):
        parsed = _parsed(lines)
        names = stage(_batches(parsed, batches), "batches")
        words = result_words(parsed, distance, neighbours, unknown_categories, as_steps=True)
        save_dictionary(words.processed, root, primary_language, secondary_language, names, words.entries)
        replace_batches(words.errors, root, "error", names, origin=RESULT)
        replace_batches(words.aside, root, "quarantine", names, origin=RESULT)


def ingest_errors(lines: DataFrame, root: str, batches: DataFrame | None = None) -> None:
    """Store the rows of error files; storing a file again replaces what it stored before.

    What result files stored for the same source batch stays.
    """
    with temporary_stages(lines.sparkSession):
        parsed = _parsed(lines)
        names = stage(_batches(parsed, batches), "batches")
        routed = stage(route_errors(parsed), "error-lines")
        replace_batches(error_rows(routed), root, "error", names, origin=ERROR)
        replace_batches(quarantine_rows(routed), root, "quarantine", names, origin=ERROR)


def ingest_documents(documents: DataFrame, root: str, **options) -> None:
    """Store whole ``{results, errors}`` documents (``read_result_documents``) in one step.

    A document that can't be read is set aside, and still replaces what its file stored before.
    """
    with temporary_stages(documents.sparkSession):
        documents = stage(documents, "documents", **LONG_ROWS)
        names = documents.select(F.col("source").alias("source_batch"))
        words = result_words(
            document_rows(documents, "results"),
            as_steps=True,
            **{k: v for k, v in options.items() if k in ("distance", "neighbours", "unknown_categories")},
        )
        languages = {k: v for k, v in options.items() if k in ("primary_language", "secondary_language")}
        errors = stage(route_errors(document_rows(documents, "errors")), "error-lines")
        save_dictionary(words.processed, root, batches=names, entries=words.entries, **languages)
        aside = words.aside.unionByName(unread_documents(documents))
        replace_batches(words.errors, root, "error", names, origin=RESULT)
        replace_batches(aside, root, "quarantine", names, origin=RESULT)
        replace_batches(error_rows(errors), root, "error", names, origin=ERROR)
        replace_batches(quarantine_rows(errors), root, "quarantine", names, origin=ERROR)
