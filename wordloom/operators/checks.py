"""Constraint checks: each returns the offending values with their number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.words import known_category
from wordloom.operators.lookups import key_counts


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; a key with a NULL in it is never a duplicate."""
    filled = df.dropna(subset=list(keys))
    return key_counts(filled, keys).filter(F.col("n_rows") > 1)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values of ``child.key`` without a parent row; NULL refers to nothing and is fine.

    The child rows are counted per value first, so a frequent value meets the join once.
    """
    wanted = key_counts(child.filter(F.col(key).isNotNull()), [key])
    present = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return wanted.join(present, F.col(key) == F.col("_parent"), "left_anti")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n_rows`` for each of the columns that holds a NULL."""
    counted = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    rows = counted.unpivot([], [F.col(name) for name in columns], "column", "n_rows")
    return rows.filter(F.col("n_rows") > 0)


def outside_domain(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Values of ``column`` that are not in ``allowed``, NULL aside."""
    strange = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return key_counts(strange, [column])


def split_by_category(df: DataFrame, label: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with a known grammar label, and the others."""
    known = F.coalesce(known_category(label), F.lit(False))
    return df.filter(known), df.filter(~known)
