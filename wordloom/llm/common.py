"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def _at(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        raise ValueError(f"no column {name}; there are {', '.join(df.columns)}")
    return f"_{df.columns.index(name)}"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns under new names; others can't clash with them, also not in their case."""
    return _numbered(df).select(*(F.col(_at(df, name)).alias(alias) for alias, name in wanted.items()))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``id`` and ``text``."""
    return pick(df, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))


def whole_rows(df: DataFrame, text_col: str) -> DataFrame:
    """``row``, a struct of all columns in their order, and ``text``."""
    plain = _numbered(df)
    row = F.struct(*(F.col(f"_{i}").alias(name) for i, name in enumerate(df.columns)))
    return plain.select(row.alias("row"), F.col(_at(df, text_col)).cast("string").alias("text"))


def rest_and_text(df: DataFrame, text_col: str) -> DataFrame:
    """``rest``, a struct of all columns but the text, numbered by their places, and ``text``."""
    plain, at = _numbered(df), _at(df, text_col)
    rest = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in plain.columns if c != at))
    return plain.select(rest.alias("rest"), F.col(at).cast("string").alias("text"))


def with_new_text(found: DataFrame, df: DataFrame, text_col: str, rest: str, text: Column, changed: Column, length_col: str) -> DataFrame:
    """The columns of ``df`` from ``rest_and_text``, with a new text and, where it changed, its length in code points."""
    at, columns = _at(df, text_col), []
    for i, name in enumerate(df.columns):
        value = F.col(f"{rest}._{i}") if f"_{i}" != at else text
        if name == length_col and name != text_col:
            value = F.when(changed, F.char_length(text)).otherwise(value).cast(df.schema[i].dataType)
        columns.append(value.alias(name))
    return found.select(*columns)


def made_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; conditions on these columns that come later use their values, not the expressions behind them."""
    kept = [c for c in df.columns if c not in names]
    made = df.select(*kept, F.explode_outer(F.array(F.struct(*names))).alias("_made"))
    return made.select(*(F.col(c) if c in kept else F.col(f"_made.{c}").alias(c) for c in df.columns))


def id_type(df: DataFrame, name: str = "id") -> str:
    return _ddl(df.schema[name].dataType)


def _ddl(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"`{f.name}`:{_ddl(f.dataType)}" for f in kind.fields) + ">"
    return kind.simpleString()


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per worker and kept for its next tasks; a worker keeps one thing at a time."""
    forget_all_but(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget_all_but(key: tuple | None) -> None:
    """Drop what earlier operators have kept in this worker."""
    if key not in _KEPT:
        _KEPT.clear()


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: tuple | None = None) -> DataFrame:
    """``work`` over the batches of each task. ``keeps``: the key of what it takes from :func:`kept`.

    Spark gives a worker to one operator after the other, so what the last one kept is dropped first.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all_but(keeps)  # a function, as Spark would send a copy of the dict along
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)
