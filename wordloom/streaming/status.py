"""The state of remote batches, kept up to date from a stream of their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.status import latest_status, lifecycle_rank
from wordloom.schemas import BATCH_RECORD

_EVENT_TIMES = (
    "created_at",
    "in_progress_at",
    "finalizing_at",
    "completed_at",
    "failed_at",
    "expired_at",
    "cancelling_at",
    "cancelled_at",
)


def record_time() -> Column:
    """The latest thing a status record tells of (``expires_at`` lies ahead and is left out)."""
    return F.greatest(*[F.col(name) for name in _EVENT_TIMES])


def fold_records(records: DataFrame) -> DataFrame:
    """Latest status, request counts and outcome per batch; for a table or a stream.

    Times are whole seconds: of records with the same time the later state in the life of a batch
    counts, so a batch that ended stays ended.
    """
    dated = records.withColumn("record_time", record_time()).withColumn("rank", lifecycle_rank(F.col("status")))
    carried = ["record_time", "request_counts", "output_file_id", "error_file_id"]
    folded = latest_status(dated, "id", "status", ["record_time", "rank", "status"], carried)
    return folded.select("id", "status", *carried, "outcome")


def read_status_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The status records of the files that appear in ``folder``."""
    return spark.readStream.schema(BATCH_RECORD).json(folder)


def start_status(
    spark: SparkSession, folder: str, states: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the state of remote batches under ``states`` up to date; see :func:`read_states`.

    Every micro-batch is folded and added, so it costs what it holds, however many batches are known,
    and the stream itself keeps no state. Records that come again change nothing.
    """

    def store(batch: DataFrame, _: int) -> None:
        fold_records(batch).drop("outcome").write.mode("append").parquet(states)

    return (
        read_status_stream(spark, folder)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _fold_states(stored: DataFrame) -> DataFrame:
    ranked = stored.withColumn("rank", lifecycle_rank(F.col("status")))
    carried = ["record_time", "request_counts", "output_file_id", "error_file_id"]
    return latest_status(ranked, "id", "status", ["record_time", "rank", "status"], carried)


def read_states(spark: SparkSession, states: str) -> DataFrame:
    """``id, status, record_time, request_counts, ..., outcome``: one row per batch."""
    return _fold_states(spark.read.parquet(states))


def compact_states(spark: SparkSession, states: str, target: str, ended_before: int | None = None) -> None:
    """Write the folded states to a new folder, without batches that ended before a time."""
    folded = read_states(spark, states)
    if ended_before is not None:
        folded = folded.filter((F.col("outcome") == "running") | (F.col("record_time") >= ended_before))
    folded.drop("outcome").write.parquet(target)
