import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import lookups
from wordloom.operators.lookups import key_counts, lookup_join, new_rows
from wordloom.operators.ordering import dense_positions, running_totals
from wordloom.session import stage


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("chunked", [False, True])
def test_running_totals_against_a_loop(spark, parts, chunked):
    rng = random.Random(parts)
    # One group holds most of the rows, one group key is NULL.
    groups = ["hot"] * 300 + ["a"] * 20 + [None] * 15 + ["b"]
    keys = rng.sample(range(10_000), len(groups))
    rows = [(g, k, rng.randint(0, 4)) for g, k in zip(groups, keys, strict=True)]
    df = spark.createDataFrame(rows, "g STRING, k INT, n INT").repartition(parts)
    got = running_totals(
        df, ["k"], {"total": F.col("n"), "pos": F.lit(1)}, ["g"],
        chunk=F.expr("k div 700") if chunked else None,
    )
    want = set()
    for group in set(groups):
        total = 0
        members = sorted((k, n) for g, k, n in rows if g == group)
        for pos, (k, n) in enumerate(members):
            want.add((group, k, n, total, pos))
            total += n
    assert got.columns == ["g", "k", "n", "total", "pos"]
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("at_once", [2, 10_000])
def test_pieces_of_pieces_against_a_loop(spark, at_once):
    """More pieces in a group than one task may add up; NULL among the groups and the pieces."""
    rng = random.Random(at_once)
    groups = ["hot"] * 200 + ["a"] * 9 + [None] * 30
    rows = [(g, k, rng.randint(0, 4)) for g, k in zip(groups, rng.sample(range(5_000), len(groups)), strict=True)]
    rows.append(("hot", None, 3))
    df = spark.createDataFrame(rows, "g STRING, k INT, n INT")
    got = running_totals(
        df, ["k"], {"total": F.col("n"), "pos": F.lit(1)}, ["g"], F.expr("k div 40"), at_once
    )
    want = set()
    for group in set(groups):
        total = 0
        members = sorted(((k is not None, k or 0, k, n) for g, k, n in rows if g == group))
        for pos, (_, _, k, n) in enumerate(members):
            want.add((group, k, n, total, pos))
            total += n
    assert got.columns == ["g", "k", "n", "total", "pos"]
    assert {tuple(r) for r in got.collect()} == want


def test_a_million_pieces(spark):
    """Every row a piece of its own, twenty times as many as one task may add up."""
    df = spark.range(1_000_000).select((F.col("id") * 3).alias("k"), (F.col("id") % 7).alias("n"))
    got = running_totals(df, ["k"], {"pos": F.lit(1), "total": F.col("n")}, chunk=F.col("k"))
    weeks, rest = F.expr("pos div 7"), F.col("pos") % 7
    assert got.filter((F.col("k") != F.col("pos") * 3) | (F.col("total") != weeks * 21 + rest * (rest - 1) / 2)).count() == 0
    assert got.count() == 1_000_000


def test_positions_over_everything(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = dense_positions(df, ["k"])
    assert got.filter("k <> pos").count() == 0 and got.count() == 1000


@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_lookup_join_with_hot_keys(spark, how):
    words = ["hot"] * 50 + ["warm"] * 9 + ["gone"] * 40 + list("abcde") + [None]
    rows = spark.createDataFrame(list(enumerate(words)), "at INT, word STRING")
    listed = spark.createDataFrame(
        [("hot", 1), ("warm", 2), ("a", 3), ("z", 4)], "word STRING, id INT"
    )
    counts = stage(key_counts(rows, ["word"]))
    got = lookup_join(rows, listed, ["word"], how, counts, hot_rows=8)
    plain = rows.join(listed, "word", how)
    assert sorted(map(tuple, got.select(plain.columns).collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str
    )


def test_hot_keys_are_few(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_SHARE", 10)
    counts = spark.createDataFrame([("a", 500), ("b", 101), ("c", 99)] + [
        (str(n), 1) for n in range(300)], "word STRING, n_rows BIGINT")
    assert {r.word for r in lookups.hot_keys(counts, ["word"], 1).collect()} == {"a", "b"}


def test_new_rows_number_on(spark):
    known = spark.createDataFrame([("a",), ("c",)], "word STRING")
    some = spark.createDataFrame([("d",), ("b",), ("c",), ("e",)], "word STRING")
    got = {r.word: r.id for r in new_rows(some, known, ["word"], 7).collect()}
    assert got == {"b": 8, "d": 9, "e": 10}
