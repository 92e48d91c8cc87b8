"""Spark session settings and the shared folder for staged tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# JSON as JSON.parse reads it: of a repeated member the last one counts.
REPEATED_MEMBERS = "spark.sql.variant.allowDuplicateKeys"

# Writer settings for rows that may be long texts. A reader takes up to thousands of rows of a row group into memory together,
# and its size is that of compressed pages; neither row groups nor pages are measured before a hundred rows, if not told so.
LONG_ROWS = {"parquet.block.size": str(1 << 19), "parquet.page.size": str(1 << 16), "parquet.page.size.row.check.min": "1"}

_scopes = threading.local()


def build_session(app: str = "wordloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``settings`` win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        REPEATED_MEMBERS: "true",
        **settings,
    }
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Without that setting it is a folder beside the tables of the warehouse, which is shared as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged").rstrip("/")


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside. No DataFrame that reads it may outlive the block."""
    paths: list[str] = []
    outer = getattr(_scopes, "open", [])
    _scopes.open = [*outer, paths]
    try:
        yield
    finally:
        _scopes.open = outer
        for path in paths:
            delete_folder(spark, path)


def staged_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", by: Sequence[str] = (), **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, and fixes values that
    another evaluation could give differently (partition ids, sampled ranges). ``by`` names
    columns that get a folder per value, so that reads of some values leave the rest unread. ``options``
    go to the writer.
    """
    path = staged_path(df.sparkSession, label)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    df.write.options(**options).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where it is missing."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop_path):
        return []
    return [found.getPath().getName() for found in system.listStatus(hadoop_path)]


def delete_folder(spark: SparkSession, uri: str) -> bool:
    """Delete a folder with what is in it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
