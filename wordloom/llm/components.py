"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import stage


def _smallest(pairs: DataFrame) -> DataFrame:
    """``u, v, low``: every pair with the smallest node next to ``u``. The minimum is taken before rows meet it in a
    join, which Spark can split where one node has a large part of the links."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "of")
    return pairs.join(low, F.col("u") == F.col("of")).select("u", "v", F.least("low", "u").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in ``a, b``; a component is named by its smallest node.

    Null ends and links of a node with itself are left out; repeated links count once; no links give no rows. Each round
    is staged in the shared folder, so lineage stays short and no state is kept in executors or the driver.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    edges = stage(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    size = -1
    while True:
        # Large star: larger neighbours are tied to the smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # Small star: smaller neighbours, and the node itself, are tied to the smallest one.
        near = _smallest(large.where("u > v").distinct())
        small = near.select(F.col("v").alias("u"), F.col("low").alias("v")).union(near.select("u", F.col("low").alias("v")))
        edges = stage(small.where("u > v").distinct(), "links")
        found = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if found == size:
            break
        size = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
