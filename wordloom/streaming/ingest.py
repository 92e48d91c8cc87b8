"""Result files stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wordloom.plans.ingest import ingest_errors, ingest_results
from wordloom.sources.files import empty_sources, json_lines, line_columns, number_lines


def start_ingest(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    kind: str = "results",
    files_per_batch: int = 1000,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Store every result (or error) file that appears in ``folder``.

    Entries with an unknown category are set aside unless ``unknown_categories="raise"``, and lines that
    can't be read are, so one bad file never holds up the others. A file belongs to one micro-batch and a micro-batch may run again after a failure: storing
    a file replaces what it stored before, so the tables stay right. Files without a byte give a stream no
    lines; each micro-batch lists them and clears what was stored of those that this query has not cleared yet.
    Their names are held in the driver. The default trigger works through what is there and stops.
    """
    if kind not in ("results", "errors"):
        raise ValueError(f"kind must be 'results' or 'errors', got {kind!r}")
    if kind == "results":
        options.setdefault("unknown_categories", "quarantine")
    lines = line_columns(
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, lineSep="\n")
    )

    cleared: set[str] = set()

    def store(batch: DataFrame, _: int) -> None:
        arrived = json_lines(number_lines(batch))
        # One short name per empty file.
        empty = {row.source_batch for row in empty_sources(spark, folder).collect()}
        batches = spark.createDataFrame([(name,) for name in sorted(empty - cleared)], "source_batch STRING")
        if kind == "results":
            ingest_results(arrived, root, batches=batches, **options)
        else:
            ingest_errors(arrived, root, batches=batches)
        cleared.update(empty)

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
