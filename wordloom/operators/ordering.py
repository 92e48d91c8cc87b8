"""Dense positions and running totals without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import stage

# Pieces of one group whose sums one task may add up.
PIECES_AT_ONCE = 50_000


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    chunk: Column | None = None,
    pieces_at_once: int = PIECES_AT_ONCE,
) -> DataFrame:
    """Add, per name in ``totals``, the sum of its expression over the earlier rows of the group.

    ``order`` must order the rows of a group (``by``) totally. Each group is cut into pieces:
    one small row of sums per piece gives the total at its start, and only the rows of one
    piece are ordered together, so a group of any size spreads over the cluster.

    ``chunk`` may name the pieces: a value that grows with ``order`` and covers a bounded
    number of rows, such as a file block or a range of keys. It must come out the same when it
    is computed twice. Without it the rows are range-partitioned by group and order, and
    staged, because the sampled range bounds differ between evaluations.
    """
    by, order = list(by), list(order)
    weights = {name: f"_weight_{name}" for name in totals}
    pieces = df.select(
        "*", *[totals[name].cast("bigint").alias(weight) for name, weight in weights.items()]
    )
    if chunk is None:
        ranged = pieces.repartitionByRange(*by, *order)
        pieces = stage(ranged.withColumn("_piece", F.spark_partition_id()), "ranged")
    else:
        pieces = pieces.withColumn("_piece", chunk)
    # One struct as the key: NULLs in it are equal, and the rows are shuffled once for both the
    # window and the join.
    pieces = pieces.withColumn("_at", F.struct(*by, "_piece"))

    sums = pieces.groupBy("_at").agg(*[F.sum(weight).alias(weight) for weight in weights.values()])
    starts = _starts(sums, by, list(weights.values()), chunk is not None, pieces_at_once)
    inside = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.select(
        "_at",
        *df.columns,
        *[
            F.coalesce(F.sum(weight).over(inside), F.lit(0)).alias(f"_inside_{name}")
            for name, weight in weights.items()
        ],
    )
    return counted.join(starts, "_at").select(
        *df.columns,
        *[
            (F.col(f"_start_{weight}") + F.col(f"_inside_{name}")).alias(name)
            for name, weight in weights.items()
        ],
    )


def _starts(
    sums: DataFrame, by: Sequence[str], weights: Sequence[str], named: bool, pieces_at_once: int
) -> DataFrame:
    """``_at`` and, per weight, its sum over the earlier pieces of the group as ``_start_...``.

    ``named``: the pieces are those of the caller, of any number. Ranges are as many as there are
    partitions and need no look at their number.
    """
    group = [F.col("_at")[name].alias(f"_group_{at}") for at, name in enumerate(by)]
    if named:
        sums = stage(sums, "piece-sums")
        most = sums.groupBy(*group).count().agg(F.max("count").alias("n_pieces")).first().n_pieces or 0
        if most > pieces_at_once:
            keys = [F.col("_at").alias("_held"), F.col("_at._piece").alias("_order"), *group]
            totals = {f"_start_{weight}": F.col(weight) for weight in weights}
            placed = running_totals(
                sums.select(*keys, *weights), ["_order"], totals, [f"_group_{at}" for at in range(len(by))]
            )
            return placed.select(F.col("_held").alias("_at"), *totals)
    before = Window.partitionBy(*[F.col("_at")[name] for name in by]).orderBy("_at._piece")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "_at",
        *[F.coalesce(F.sum(weight).over(before), F.lit(0)).alias(f"_start_{weight}") for weight in weights],
    )


def dense_positions(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "pos",
    chunk: Column | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 in ``order``; see :func:`running_totals`."""
    return running_totals(df, order, {name: F.lit(1)}, by, chunk)
