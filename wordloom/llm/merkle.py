"""Merkle manifest of a dataset: one tree per group of rows, and one over their roots, as nested structs.

The rank of a leaf in its group, written in digits, is its path in the tree. A block holds the leaves that share
all but the last ``BLOCK_LEVELS`` digits. Grouping by all digits but the lowest puts siblings into one struct with
their hash, grouping that by all digits but the two lowest nests those structs in turn, and so on to one struct per
block, all in the partition that the block was sent to. The tops of the blocks are the leaves of the next tier,
until a group has one block. Proofs come down again: a tier's struct is unfolded by nested transforms that carry
the siblings along, and one explode gives a row per leaf.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import pick
from wordloom.operators.lookups import BROADCAST_BYTES, measured_bytes
from wordloom.operators.ordering import running_totals
from wordloom.session import stage

FAN_OUT, BLOCK_LEVELS = 2, 8  # 256 leaves in a block

_STEP = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings_hash(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def blocks(nodes: DataFrame, fan_out: int = FAN_OUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``tree, n, block, top``: the nodes of each block as one nested struct.

    ``nodes`` has ``tree, n, rank, hash, item``: ``n`` nodes in a tree with ranks from 0. A struct of the lowest level is
    ``hash, item``, of a higher one ``hash, kids``. A node that is alone in its tree is not hashed again.
    """
    size = fan_out**levels
    digit = [F.expr(f"cast(pmod(rank div {fan_out**i}, {fan_out}) as int)") for i in range(levels)]
    held = nodes.select(
        "tree", "n", F.expr(f"rank div {size}").alias("block"),
        *(d.alias(f"d{i}") for i, d in enumerate(digit)), F.struct("hash", "item").alias("node"),
    ).repartition("tree", "block")
    for i in range(levels):
        rest = [f"d{j}" for j in range(i + 1, levels)]
        kids = F.transform(F.array_sort(F.collect_list(F.struct(f"d{i}", "node"))), lambda x: x["node"])
        held = held.groupBy("tree", "n", "block", *rest).agg(kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda kid: kid["hash"]), "")
        # All nodes of a tree are under its first one when they are no more than the fan-out to that level.
        top = F.when(F.col("n") <= fan_out**i, F.col("kids")[0]["hash"]).otherwise(F.sha2(joined, 256))
        held = held.select("tree", "n", "block", *rest, F.struct(top.alias("hash"), "kids").alias("node"))
    return held.select("tree", "n", "block", F.col("node").alias("top"))


def _unfolded(node: Column, n: Column, path: Column, level: int, fan_out: int) -> Column:
    """The leaves under a node as an array of ``hash, item, path``."""
    if level == 0:
        return F.array(F.struct(node["hash"].alias("hash"), node["item"].alias("item"), path.alias("path")))

    def of_kid(kid: Column, i: Column) -> Column:
        hashes = F.transform(node["kids"], lambda x: x["hash"])
        before = F.array_join(F.slice(hashes, F.lit(1), i), "")
        after = F.array_join(F.slice(hashes, i + 2, F.lit(fan_out)), "")
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        here = F.when(n <= fan_out ** (level - 1), F.array().cast(_STEP)).otherwise(step)
        return _unfolded(kid, n, F.concat(here, path), level - 1, fan_out)

    return F.flatten(F.transform(node["kids"], of_kid))


def climb(nodes: DataFrame, fan_out: int = FAN_OUT, levels: int = BLOCK_LEVELS, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``tree, rank, hash, item, path, subroot, root`` of ``tree, n, rank, hash, item``.

    ``path`` goes from a node to the root: what stands before and after it at each level. ``above`` gets ``tree, subroot``
    and gives for each tree the path that goes on from there: ``tree, path, subroot, root``.
    """
    size = fan_out**levels
    made = stage(blocks(nodes, fan_out, levels), "merkle-blocks")
    if (made.agg(F.max("n")).first()[0] or 0) > size:
        blocks_of = F.expr(f"(n + {size - 1}) div {size}").alias("n")
        tops = made.select("tree", blocks_of, F.col("block").alias("rank"), F.col("top.hash").alias("hash"), F.lit(None).cast("int").alias("item"))
        upper = climb(tops, fan_out, levels, above).select("tree", F.col("rank").alias("block"), "path", "subroot", "root")
    else:  # one block to a tree
        roots = made.select("tree", F.col("top.hash").alias("subroot"))
        ends = above(roots) if above else roots.select("tree", F.array().cast(_STEP).alias("path"), "subroot", F.col("subroot").alias("root"))
        upper = ends.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    # Each block meets the path above it by grouping the two tables as one: two rows to a block.
    both = made.unionByName(upper, allowMissingColumns=True)
    met = both.groupBy("tree", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "top", "path", "subroot", "root")))
    leaves = met.select("tree", "block", "subroot", "root", F.posexplode(_unfolded(F.col("top"), F.col("n"), F.col("path"), levels, fan_out)).alias("at", "leaf"))
    return leaves.select("tree", (F.col("block") * size + F.col("at")).alias("rank"), "leaf.hash", "leaf.item", "leaf.path", "subroot", "root")


def _ranked(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Add ``rank`` from 0 and the size ``n`` of the group to staged rows, without ordering a group in one task."""
    placed = running_totals(rows, order, {"rank": F.lit(1)}, by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes) if measured_bytes(sizes) <= BROADCAST_BYTES else sizes
    same = F.lit(True)
    for c in by:
        same &= F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    return placed.alias("p").join(sizes.alias("s"), same).select("p.*", "s.n")


def manifest(
    docs: DataFrame,
    changed: Column | None = None,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    count_col: str = "n_chars",
    fan_out: int = FAN_OUT,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``id, group, leaf, other_leaf, path, subroot, root``: every row with its place in the tree of its group.

    A leaf is the hash of ``fields``. Leaves of a group ascend by the id, null ids first; rows of one id stand in the order
    of their leaves, so repeated rows each have a place. Runs of ``fan_out`` nodes, the last one with fewer, are hashed
    together while there is more than one node; what remains is the ``subroot``. The subroots, ordered by group, null first,
    give the ``root`` likewise. ``path`` leads from the leaf to the root: what stands before and after it at each level.

    ``other_leaf`` is null, or where ``changed`` (a condition on ``id``) holds the leaf with one more in ``count_col`` (null
    stays null). Texts of any length are hashed where they are; only hashes are shuffled. An empty table gives no rows.
    Columns are taken by name from ``docs`` only; others can't clash with them.
    """
    names = {f"f{i}": name for i, name in enumerate(fields)}
    rows = pick(docs, id=id_col, group=group_col, **names)
    values = [F.col(c) for c in names]
    leaf = leaf_hash(*values)
    more = [(v.cast("decimal(38,0)") + 1) if names[c] == count_col else v for c, v in zip(names, values, strict=True)]
    other = F.when(changed, leaf_hash(*more)) if changed is not None else F.lit(None).cast("string")
    hashed = stage(rows.select("id", F.col("group").cast("string").alias("group"), leaf.alias("leaf"), other.alias("other_leaf")), "merkle-leaves")
    ranked = _ranked(hashed, ["id", "leaf"], ["group"])
    nodes = ranked.select(F.col("group").alias("tree"), "n", "rank", F.col("leaf").alias("hash"), F.struct("id", "other_leaf").alias("item"))

    def over_groups(roots: DataFrame) -> DataFrame:
        """The groups are one tree; the item carries the group."""
        one = stage(roots.select(F.lit("").alias("all"), F.col("tree").alias("group"), "subroot"), "merkle-groups")
        ordered = _ranked(one, ["group"], ["all"])
        found = climb(ordered.select(F.col("all").alias("tree"), "n", "rank", F.col("subroot").alias("hash"), F.struct("group").alias("item")), fan_out, levels)
        return found.select(F.col("item.group").alias("tree"), "path", F.col("hash").alias("subroot"), "root")

    placed = climb(nodes, fan_out, levels, over_groups)
    return placed.select("item.id", F.col("tree").alias("group"), F.col("hash").alias("leaf"), "item.other_leaf", "path", "subroot", "root")
