"""Approximate nearest neighbours: shards with a robust-pruned graph each, searched by beams.

Vectors are dealt to shards of a bounded number of rows by a hash of their ids, so that no group of like vectors
makes a shard large. A task builds the graph of a shard and writes its nodes as rows; this index table outlives the
executors. Every query searches every shard, in blocks of queries, and the best of all shards are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import id_type, pick
from wordloom.llm.pruned_graph import BUILD_BEAM, DEGREE, RELAXED, SEARCH_BEAM, Graph, build, lifted
from wordloom.session import stage

SHARD_ROWS, QUERY_BLOCK, NEAREST = 8192, 16384, 20
_SEARCHED_AT_ONCE = 512


class Index(NamedTuple):
    """``nodes``: ``dims, shard, node, ids, vector, edges``, one row per distinct vector of a shard."""

    nodes: DataFrame
    shards: int


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector``: one row per id, the least vector of those it has.

    Left out are null ids, and vectors that are null, empty or zero or that hold null or non-finite components.
    """
    rows = pick(vectors, id=id_col, vector=vector_col)
    kind = rows.schema["vector"].dataType.elementType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    inf = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1) + 0.0  # no negative zeros


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> Index:
    """The index, staged, of ``id, vector`` rows (:func:`usable_vectors`); vectors of one length share shards."""
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select("id", "vector", F.size("vector").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    schema = f"dims int, shard int, node int, ids array<{id_type(rows)}>, vector array<double>, edges array<int>"

    def of_shard(key: tuple, table: pa.Table) -> pa.Table:
        dims, shard = (x.as_py() for x in key)
        table = table.sort_by("id")
        distinct, first, node = np.unique(_matrix(table.column("vector"), table.num_rows), axis=0, return_index=True, return_inverse=True)
        # Nodes in the order of their least ids: copies of a vector are one node.
        order = np.argsort(first, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        node, distinct = place[node.ravel()], distinct[order]
        graph = build(distinct, degree, beam, relaxed)
        by_node = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[by_node], np.arange(len(distinct) + 1)).astype(np.int32)
        ids = table.column("id").combine_chunks().take(pa.array(by_node))
        n = len(distinct)
        fixed = [pa.array(np.full(n, x, np.int32)) for x in (dims, shard)]
        steps = [pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)) for w in (dims, degree)]
        lists = [
            pa.ListArray.from_arrays(pa.array(starts), ids),
            pa.ListArray.from_arrays(steps[0], pa.array(distinct.ravel())),
            pa.ListArray.from_arrays(steps[1], pa.array(graph.edges.ravel())),
        ]
        return pa.Table.from_arrays([*fixed, pa.array(np.arange(n, dtype=np.int32)), *lists], names=["dims", "shard", "node", "ids", "vector", "edges"])

    return Index(stage(dealt.groupBy("dims", "shard").applyInArrow(of_shard, schema), "vector-index"), shards)


def _best(ids: list[list], scores: np.ndarray, own: object, k: int) -> list[tuple]:
    """The best ``k`` of the members of nodes that come by falling score; ties to smaller ids."""
    out: list[tuple] = []
    last = None
    for members, score in zip(ids, scores.tolist(), strict=True):
        if len(out) > k and score != last:
            break
        out += [(-score, x) for x in members[: k + 1]]
        last = score
    return [x for x in sorted(out) if x[1] != own][:k]


def _search_shard(nodes: pa.Table, queries: pa.Table, k: int, beam: int) -> Iterator[tuple]:
    nodes = nodes.sort_by("node")
    vectors, members = _matrix(nodes.column("vector"), nodes.num_rows), nodes.column("ids").to_pylist()
    edges = nodes.column("edges").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    graph = Graph(lifted(vectors), edges)
    wanted = min(k + 1, sum(map(len, members)))
    own, asked = queries.column("id").to_pylist(), _matrix(queries.column("vector"), queries.num_rows)
    for at in range(0, len(asked), _SEARCHED_AT_ONCE):
        some = asked[at : at + _SEARCHED_AT_ONCE]
        scaled = some / np.abs(some).max(axis=1, keepdims=True)
        found, _, _ = graph.search(np.column_stack([scaled, np.zeros(len(some))]).astype(np.float32), max(beam, k + 1))
        scores = np.where(found >= 0, np.einsum("ij,ikj->ik", some, vectors[found]), -np.inf)
        order = np.argsort(-scores, axis=1, kind="stable")
        for i, places in enumerate(np.take_along_axis(found, order, 1)):
            places = places[places >= 0]
            row = scores[i][order[i]][: len(places)]
            if sum(len(members[p]) for p in places.tolist()) < wanted:  # what the searches can't reach
                row = vectors @ some[i]
                places = np.argsort(-row, kind="stable")
                row = row[places]
            for score, vec_id in _best([members[p] for p in places.tolist()], row, own[at + i], k):
                yield own[at + i], vec_id, -score


def search_index(index: Index, queries: DataFrame, k: int = NEAREST, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``id, vector`` queries; an id is no neighbour of itself."""
    blocks = max(1, -(-queries.count() // query_block))
    nodes = index.nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select("id", "vector", F.size("vector").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    kind = id_type(queries)
    key = ["dims", "shard", "block"]

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_search_shard(left, right, k, beam)) if left.num_rows and right.num_rows else []
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        types = [left.schema.field("ids").type.value_type] * 2 + [pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "vec_id", "score"])

    near = nodes.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(of_block, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame,
    every: int,
    k: int = NEAREST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    build_beam: int = BUILD_BEAM,
    relaxed: float = RELAXED,
    search_beam: int = SEARCH_BEAM,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each vector whose id ``every`` divides, the ``k`` others with the largest inner products that are found.

    Columns ``query_id, rank`` (from 1), ``vec_id, score``: the inner product of the vectors as they are, in double
    precision; ties go to the smaller id. With ``k`` candidates or fewer all are found. Copies of a vector are one node
    of their shard's graph, with all ids, so no number of copies fills a graph or a beam.

    Vectors that are null, empty or zero, or hold null or non-finite components, and null ids take no part. A vector meets
    those of its own length only. An id counts once, with the least of its vectors. An empty table gives no rows; other
    columns are not read. Each row is indexed. A query visits each shard, so searches grow with queries times rows over
    ``shard_rows``; a task holds one shard and one block of queries. Executors that are lost cost the shards they had.
    """
    rows = stage(usable_vectors(vectors, id_col, vector_col), "vectors")
    index = build_index(rows, shard_rows, degree, build_beam, relaxed)
    return search_index(index, rows.where(F.col("id") % every == 0), k, search_beam, query_block)
