"""Pages of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.ordering import dense_positions
from wordloom.session import stage

# Rows up to the end of a page that may be gathered in one place.
NEAR_ROWS = 10_000


def page(
    df: DataFrame,
    where: Mapping[str, object] | None = None,
    order_by: Sequence[Column | str] = (),
    skip: int = 0,
    take: int | None = None,
    near_rows: int = NEAR_ROWS,
) -> DataFrame:
    """Rows equal to ``where``, in order, without the first ``skip``, at most ``take``.

    ``skip`` without ``take`` leaves most of the table: its rows are numbered in pieces, not sent through
    one task. A page that ends behind ``near_rows`` is looked up in counted ranges (:class:`OrderedRanges`).
    Both need an order, by default that of all columns. Rows that are equal in it come in any order.
    """
    for name, value in (where or {}).items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    if skip and take is None:
        numbered = dense_positions(df, list(order_by) or df.columns, name="_place")
        return numbered.filter(F.col("_place") >= skip).drop("_place")
    if take is not None and skip + take > near_rows:
        return OrderedRanges(df, list(order_by) or df.columns).page(skip, take)
    if order_by:
        df = df.orderBy(*order_by)
    if skip:
        df = df.offset(skip)
    return df if take is None else df.limit(take)


class OrderedRanges:
    """A table cut into ranges of an order, each counted, for pages at any depth.

    The rows are range-partitioned once and staged in a folder per range. A page then reads the ranges
    that hold it and nothing else. Only the counts, a row per range, reach the driver. Keep the object to read
    more pages of the same order. The staged rows stay as they were when it was made. ``n_ranges`` fixes the
    number of ranges; without it Spark chooses it by the bytes shuffled.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[Column | str], n_ranges: int | None = None) -> None:
        self.columns, self.order = df.columns, list(order_by)
        number = [] if n_ranges is None else [n_ranges]
        ranged = df.repartitionByRange(*number, *self.order).withColumn("_range", F.spark_partition_id())
        self.rows = stage(ranged, "ranges", by=["_range"])
        counts = self.rows.groupBy("_range").count().orderBy("_range").collect()
        self.starts: list[tuple[int, int, int]] = []  # range, its first place, the place behind its last
        end = 0
        for row in counts:
            self.starts.append((row["_range"], end, end + row["count"]))
            end += row["count"]

    def __len__(self) -> int:
        """The number of rows."""
        return self.starts[-1][2] if self.starts else 0

    def page(self, skip: int, take: int) -> DataFrame:
        """Rows from place ``skip``, at most ``take``, in order; read from the ranges that hold them."""
        held = [(part, start) for part, start, end in self.starts if start < skip + take and end > skip]
        if not held:
            return self.rows.select(*self.columns).limit(0)
        starts = self.rows.sparkSession.createDataFrame(held, "_range INT, _start BIGINT")
        inside = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order))
        # One row per range, so the list is as short as the partitions are few.
        first, last = held[0][0], held[-1][0]
        found = self.rows.filter(F.col("_range").between(first, last)).withColumn("_inside", inside)
        found = found.join(F.broadcast(starts), "_range").withColumn("_place", F.col("_start") + F.col("_inside") - 1)
        found = found.filter((F.col("_place") >= skip) & (F.col("_place") < skip + take))
        return found.orderBy("_place").select(*self.columns)


def page_after(df: DataFrame, key: str, after: object | None = None, size: int = 20) -> DataFrame:
    """The next ``size`` rows in the order of a unique ``key``, behind the last one seen."""
    if after is not None:
        df = df.filter(F.col(key) > F.lit(after))
    return df.orderBy(key).limit(size)


def find_one(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this unique key, or none."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)
