"""Joins against a keyed list, safe against hot keys and against lists of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.ordering import dense_positions
from wordloom.session import stage

# A list up to this size, as measured, is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
# A key is hot when it holds more than one row in this many, so fewer keys than this are hot.
HOT_SHARE = 200_000
# Below this number of rows a key is never hot.
HOT_ROWS = 100_000


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size, from the rows themselves."""
    length = F.lit(16 * len(df.columns))
    for name in df.columns:
        length += F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    return df.agg(F.sum(length)).first()[0] or 0


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; summed before the shuffle, so a hot key costs one row per task."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def hot_keys(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys that hold more than one in ``HOT_SHARE`` rows: fewer than that many keys."""
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.filter(F.col("n_rows") > max(total // HOT_SHARE, hot_rows)).select(*keys)


def lookup_join(
    rows: DataFrame,
    listed: DataFrame,
    keys: Sequence[str],
    how: str,
    counts: DataFrame,
    hot_rows: int = HOT_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` with a list that has each key once; ``how`` is inner or left_anti.

    Rows with a hot key stay where they are and meet the few listed hot keys by broadcast; the
    others are joined by a shuffle, in which no key is hot. ``counts`` holds the rows per key
    of ``rows`` (:func:`key_counts`), staged by the caller.
    """
    if how not in ("inner", "left_anti"):
        raise ValueError(f"how must be 'inner' or 'left_anti', got {how!r}")
    keys = list(keys)
    # Fewer than HOT_SHARE keys, by their definition.
    hot = F.broadcast(hot_keys(counts, keys, hot_rows))
    hot_rows_listed = listed.join(hot, keys, "left_semi")
    # Few rows, but a key may be a long text: beyond the limit Spark chooses the join.
    small = measured_bytes(hot_rows_listed) <= broadcast_bytes
    hot_listed = F.broadcast(hot_rows_listed) if small else hot_rows_listed
    return (
        rows.join(hot, keys, "left_semi")
        .join(hot_listed, keys, how)
        .unionByName(rows.join(hot, keys, "left_anti").join(listed, keys, how))
    )


def drop_listed(
    rows: DataFrame,
    key: Column,
    listed: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows whose ``key`` is not in the one column of ``listed``.

    A row without key stays. Order, spelling and repeats of the rows are kept. A list within
    ``broadcast_bytes``, as measured, is broadcast and the rows stay where they are; a larger
    one is joined by a shuffle that leaves out hot keys.
    """
    name = listed.columns[0]
    listed = listed.filter(F.col(name).isNotNull()).select(F.col(name).alias("_key")).distinct()
    keyed = rows.withColumn("_key", key)
    if measured_bytes(listed) <= broadcast_bytes:
        return keyed.join(F.broadcast(listed), "_key", "left_anti").drop("_key")
    counts = stage(key_counts(keyed, ["_key"]), "key-counts")
    return lookup_join(keyed, listed, ["_key"], "left_anti", counts, hot_rows, broadcast_bytes).drop("_key")


def largest_id(df: DataFrame, id_name: str = "id") -> int:
    return df.agg(F.coalesce(F.max(id_name), F.lit(0)).cast("bigint")).first()[0]


def new_rows(
    candidates: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    last_id: int,
    order: Sequence[str] = (),
    id_name: str = "id",
) -> DataFrame:
    """The candidates whose key is not in ``existing``, numbered on from ``last_id``.

    Each candidate key comes once, so no key is hot. Ids follow ``order``, or else the keys.
    """
    missing = candidates.join(existing.select(*keys), list(keys), "left_anti")
    numbered = dense_positions(missing, order=list(order or keys), name="_index")
    return numbered.select((F.col("_index") + F.lit(last_id + 1)).alias(id_name), *keys)
