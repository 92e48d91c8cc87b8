import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm.catalog.op11 import op11_pruned_graph
from wordloom.llm.nearest import build_index, nearest, search_index, usable_vectors
from wordloom.llm.pruned_graph import build, lifted, robust_prune

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>"


def brute(rows, every, k):
    """Exact neighbours; of an id with several vectors the least one."""
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(x) for x in np.array(v, np.float32)]
        good[i] = min(good.get(i, v), v)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in good.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(len(near) for near in want.values())


def same_scores(got, rows):
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert [s for _, s in near] == pytest.approx([float(vectors[q] @ vectors[i]) for i, _ in near], rel=1e-12)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_over_whole_tables(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, want = found(op11_pruned_graph(spark, f"/root/testdata/{sf}")), brute(rows, 20, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert all(len(near) == 20 for near in got.values())
    same_scores(got, rows)


def test_several_shards_and_blocks(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(8, 24))
    data = centres[random.integers(0, 8, 1500)] + 0.4 * random.normal(size=(1500, 24))
    data *= random.uniform(0.5, 3, size=(1500, 1))  # lengths differ
    rows = [(int(i), v.tolist()) for i, v in zip(random.choice(10**12, 1500, replace=False), data, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, want = found(nearest(df, 5, 10, shard_rows=400, query_block=100)), brute(rows, 5, 10)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    same_scores(got, rows)


def test_copies_are_all_there_with_smallest_ids_first(spark):
    random = np.random.default_rng(2)
    hot = random.normal(size=16).tolist()
    rows = [(i, hot if i % 3 == 0 else random.normal(size=16).tolist()) for i in range(-600, 900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = found(nearest(df, 20, 20, shard_rows=300)), brute(rows, 20, 20)
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert recall(got, want) >= 0.9


def test_few_candidates_are_all_found(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, [-1.0, 0.0]), (40, [1.0])]
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), 20))
    assert got == {20: [(1, 0.5), (2, 0.5), (3, -1.0)]}


def test_nulls_repeated_ids_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [-2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (20, [0.0, -1.0]), (40, [0.0, 0.0]), (60, [1.0]), (80, [2.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "vector", "shard", "dims", "block", "query_id", "score"):
        df = df.withColumn(name, F.lit("x"))
    got, want = found(nearest(df, 20)), brute(rows, 20, 20)
    assert got == want and set(got) == {0, 20, 60, 80}


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), 20).collect() == []


def test_doubles_and_whole_numbers(spark):
    wide = spark.createDataFrame([(0, [1e-200, 3e150]), (1, [1.0, 1.0]), (2, [2.0, 1.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert found(nearest(wide, 20)) == {0: [(1, 3e150), (2, 3e150)]}
    whole = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id INT, embedding ARRAY<INT>")
    assert found(nearest(whole, 20)) == {0: [(1, 11.0)]}


def test_every_row_is_indexed_and_other_queries_can_be_asked(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=8).tolist()) for i in range(500)]
    held = usable_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    index = build_index(held, 200)
    assert sorted(i for r in index.nodes.collect() for i in r.ids) == list(range(500)) and index.shards == 3
    asked = spark.createDataFrame([(-1, rows[7][1])], "id BIGINT, vector ARRAY<FLOAT>")
    best = search_index(index, asked, 1).first()
    assert best.vec_id == max(rows, key=lambda r: float(np.dot(r[1], rows[7][1])))[0]


def test_pruning_keeps_the_nearest_and_diverse_ones():
    points = lifted(np.array([[1.0, 0.0], [0.99, 0.1], [0.98, 0.12], [0.9, -0.4], [-1.0, 0.1]]) / 1.2)
    kept = robust_prune(points, np.array([0]), np.array([[0, 1, 2, 2, 3, 4, -1]]), 4, 1.2)[0].tolist()
    assert kept[0] == 1 and 2 not in kept and 3 in kept and 0 not in kept


def test_graph_has_bounded_degree_and_no_loops():
    graph = build(np.random.default_rng(4).normal(size=(700, 12)), degree=10)
    for i, row in enumerate(graph.edges.tolist()):
        ends = [x for x in row if x >= 0]
        assert len(ends) == len(set(ends)) <= 10 and i not in ends and ends
