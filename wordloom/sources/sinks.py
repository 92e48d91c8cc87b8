"""Writers: request files and dictionary tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators.lookups import largest_id
from wordloom.operators.requests import oversized_batches
from wordloom.schemas import FILLED, MAX_FILE_BYTES, MAX_REQUESTS, PARTITIONS, TABLES
from wordloom.session import delete_folder, folder_names, path_exists, stage

# Rows of a batch, by their ids, that one task writes, and places whose texts and rows are.
ROWS_PER_SLOT = 1 << 18
PLACES_PER_SLOT = 1 << 11


class BatchTooLarge(ValueError):
    """A request batch is beyond the line or byte limit of one file."""


def write_requests(
    requests: DataFrame,
    folder: str,
    by: Sequence[str] = ("source", "batch_id"),
    max_lines: int = MAX_REQUESTS,
    max_bytes: int = MAX_FILE_BYTES,
) -> None:
    """One ordered JSONL file per batch, in one folder per batch.

    The sizes are checked before anything is written, and bound what one task writes.
    """
    by = list(by)
    lines = stage(requests.select(*by, "request_id", "line"), "request-lines")
    worst = oversized_batches(lines, by, "line", max_lines, max_bytes).take(1)
    if worst:
        size = worst[0].asDict()
        raise BatchTooLarge(
            f"batch {[size[name] for name in by]} has {size['n_lines']} lines and "
            f"{size['n_bytes']} bytes; the limits are {max_lines} and {max_bytes}"
        )
    (
        lines.repartition(*by)
        .sortWithinPartitions(*by, "request_id")
        .select(*by, "line")
        .write.partitionBy(*by)
        .text(folder)
    )


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A dictionary table; without rows when it was never written."""
    path = table_path(root, table)
    if not path_exists(spark, path):
        return spark.createDataFrame([], TABLES[table])
    stored = spark.read.schema(TABLES[table]).parquet(path)
    return stored.filter(F.col(FILLED[table]).isNotNull()) if table in FILLED else stored


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    """``table_name, last_id``, a row per table (two after a save that broke off)."""
    path = table_path(root, "id_counter")
    if not folder_names(spark, path):
        return spark.createDataFrame([], TABLES["id_counter"])
    return spark.read.schema(TABLES["id_counter"]).parquet(path).select("table_name", "last_id")


def last_ids(spark: SparkSession, root: str, tables: Sequence[str]) -> dict[str, int]:
    """The largest id given out per table, from the small counter table.

    A table without a counter is looked at itself.
    """
    counters = read_counters(spark, root).filter(F.col("table_name").isin(*tables))
    # One row per table.
    rows = counters.groupBy("table_name").agg(F.max("last_id").alias("last_id")).collect()
    known = {row.table_name: row.last_id for row in rows}
    return {
        table: known[table] if table in known else largest_id(read_table(spark, root, table))
        for table in tables
    }


def reserve_ids(spark: SparkSession, root: str, last: Mapping[str, int]) -> None:
    """Note the ids that the rows about to be written will take.

    Noted before the write: after a failure some ids stay unused, but none is used twice. The
    counters are one small file: a new set is written, then the sets before it go.
    """
    path = table_path(root, "id_counter")
    old = folder_names(spark, path)
    counters = {row.table_name: row.last_id for row in read_counters(spark, root).orderBy("last_id").collect()}
    for table, value in last.items():
        counters[table] = max(value, counters.get(table, value))
    rows = spark.createDataFrame(sorted(counters.items()), TABLES["id_counter"]).coalesce(1)
    rows.write.parquet(f"{path}/set={uuid.uuid4().hex}")
    for name in old:
        delete_folder(spark, f"{path}/{name}")


def append_rows(rows: DataFrame, root: str, table: str) -> None:
    """Add rows; they must not come from a plan that reads the same table."""
    balanced = rows.select(*table_columns(table)).hint("rebalance", *PARTITIONS[table])
    balanced.write.mode("append").partitionBy(*PARTITIONS[table]).parquet(table_path(root, table))


def replace_batches(
    rows: DataFrame, root: str, table: str, batches: DataFrame, texts: DataFrame | None = None, **fixed: int | str
) -> None:
    """Make ``rows`` the rows of their source batches, whatever an earlier run left there.

    ``batches`` lists every ``source_batch`` of the run, also those without rows here. Each gets a
    row that only marks it, so that its partition is written anew: nothing that is stored has to be
    listed, read or deleted one by one, however large the table is. ``fixed`` holds the values of the
    other partition columns.

    Rows are dealt to a fixed number of tasks by their batch and a slot: a run of ``ROWS_PER_SLOT`` ids, or the task the
    row comes from. So a batch of any size is cut, and many small ones are not left to one task, which would write
    their folders one after the other.

    ``texts`` (``source_batch, pos`` and a column of the table) has texts that many rows share: ``rows`` then have the
    ``pos`` of theirs in place of that column. Each text is sent once, and meets its rows where they are written, in order,
    so that its copies stand side by side and take little room.
    """
    path, partitions = table_path(root, table), PARTITIONS[table]
    rows = rows.withColumns({name: F.lit(value) for name, value in fixed.items()})
    columns = table_columns(table)
    shared = texts.columns[-1] if texts is not None else None
    wanted = rows.select(*(F.lit(None).cast("string").alias(name) if name == shared else name for name in columns), *(["pos"] if shared else []))
    names = {"source_batch": F.col("source_batch"), **{name: F.lit(value) for name, value in fixed.items()}}

    def filled_up(told: DataFrame, **more: Column) -> DataFrame:
        kinds = {field.name: field.dataType for field in wanted.schema}
        return told.select(*[{**names, **more}.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])

    marks = filled_up(batches.select("source_batch").distinct(), pos=F.lit(-1))
    if shared:
        told = filled_up(texts, pos=F.col("pos"), **{shared: F.col(shared)})
        _write_batches(_with_texts(wanted, marks, told, shared, partitions), path, partitions, compression="zstd")
        return
    slot = F.expr(f"id div {ROWS_PER_SLOT}") if "id" in wanted.columns else F.spark_partition_id()
    dealt = wanted.withColumn("_slot", slot.cast("bigint")).unionByName(marks.withColumn("_slot", F.lit(-1).cast("bigint")))
    _write_batches(dealt.repartition(_tasks(rows), *partitions, "_slot").drop("_slot"), path, partitions)


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_texts(rows: DataFrame, marks: DataFrame, texts: DataFrame, shared: str, partitions: Sequence[str]) -> DataFrame:
    """``rows`` and ``marks`` with the ``shared`` column of the text at their ``pos``; rows of near places in one task.

    The order in which a text meets its rows is the one in which they are written: they are not sorted again.
    """
    told = texts.withColumn("_told", F.lit(0)).unionByName(rows.unionByName(marks).withColumn("_told", F.lit(1)))
    # A folder's name can't be empty, so no name is as good as an empty one; the writer needs no look for it then.
    named = told.withColumn("source_batch", F.coalesce("source_batch", F.lit("")))
    dealt = named.withColumn("_slot", F.expr(f"pos div {PLACES_PER_SLOT}")).repartition(_tasks(rows), *partitions, "_slot")
    place = Window.partitionBy(*partitions, "_slot", "pos").orderBy("_told").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.withColumn(shared, F.first(shared).over(place))
    return met.filter(F.col("_told") == 1).drop("_told", "_slot", "pos")


def _write_batches(rows: DataFrame, path: str, partitions: Sequence[str], **options: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
    writer.partitionBy(*partitions).parquet(path)


def table_columns(table: str) -> list[str]:
    """Column names of a table in the order of its schema."""
    return [field.strip().split(" ")[0] for field in TABLES[table].split(", ")]
