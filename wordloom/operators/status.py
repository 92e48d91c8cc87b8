"""Current state of each remote batch, from its status records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.schemas import DONE_STATE, FAILED_STATES, LIFECYCLE


def batch_outcome(status: Column) -> Column:
    """failed, done or running."""
    return (
        F.when(status.isin(*FAILED_STATES), "failed")
        .when(status == DONE_STATE, "done")
        .otherwise("running")
    )


def lifecycle_rank(status: Column) -> Column:
    """Place of a state in the life of a batch; a state that is not known comes before all others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LIFECYCLE)), status), F.lit(0))


def latest_status(
    records: DataFrame, key: str, status: str, order: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """The last record per batch by ``order``: key, status, ``carry`` columns, ``outcome``.

    Works on a table and on a stream. The maximum is taken before the shuffle, so a batch with
    most of the records costs one row per task.
    """
    last = F.max_by(F.struct(status, *carry), F.struct(*order)).alias("_last")
    return records.groupBy(key).agg(last).select(
        key, "_last.*", batch_outcome(F.col(f"_last.{status}")).alias("outcome")
    )
