import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions.text import capitalise, clean_subtitle, split_words, strip_white
from wordloom.operators.subtitles import (
    corpus_words,
    distinct_words,
    remove_words,
    subtitle_tokens,
    text_words,
)
from wordloom.plans.decks import deck_words
from wordloom.sources.files import read_subtitles

WHITE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
WHITE += "\u2028\u2029\u202f\u205f\u3000\ufeff"

SHORT = (
    "1\n00:00:01,000 --> 00:00:02,500\n<i>Guten Morgen, Fräulein Maier-Schmidt!</i>\n\n"
    "2\n00:00:03,000 --> 00:00:04,000\n- Wie geht's? ♪\n[Tür knallt]\n\n"
    "3\n00:00:05,000 --> 00:00:06,000\nGUTEN Morgen 1984\n"
)


def by_hand(text):
    """The rules, line by line."""
    import unicodedata

    lines = text.split("\n")
    kept = [
        line
        for at, line in enumerate(lines)
        if "-->" not in line and not (at and re.fullmatch("[0-9]+", lines[at - 1]))
    ]
    kept = [re.sub("<[^>]*>", "", line) for line in kept]
    kept = [line for line in kept if line.strip(WHITE)]
    joined = "".join(
        c for c in " ".join(kept)
        if unicodedata.category(c)[0] in "LM" or c in WHITE or c == "-"
    )
    return re.split(f"[{WHITE}]+", joined)


def tokens_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc INT, text STRING")
    rows = df.select("doc", split_words(clean_subtitle(F.col("text"))).alias("t")).collect()
    return [row.t for row in sorted(rows, key=lambda row: row.doc)]


def test_short_subtitle(spark):
    [tokens] = tokens_of(spark, [SHORT])
    assert tokens == [
        "", "Guten", "Morgen", "Fräulein", "Maier-Schmidt", "-", "Wie", "gehts",
        "Tür", "knallt", "GUTEN", "Morgen", "",
    ]
    assert tokens == by_hand(SHORT)


CASES = [
    "",
    " ",
    "\n",
    "a\n",
    " a ",
    "a\n   ",
    "1",
    "1\n",
    "1\nlost\nkept",
    "1\r\nkept\r\n",
    "1\n2\n3\nlost\nkept",
    "1984\n<b>lost</b>\nkept",
    "x --> y",
    "<i>\na</i>",
    "<a<b>c",
    "a<b\nc>d",
    "\u0001\nword",
    "\u00a0\nword\u3000",
    "\u2028 \n\ufeff",
    "1\n\u0001lost\nkept",
    "\ufeff1\nkept",
    "no\u00a0break",
    "-",
    "straße -- ß",
    "été",
    "\n".join(["7"] * 20_000) + "\nlost\nkept",
    "long " * 30_000,
]


def test_cases(spark):
    assert tokens_of(spark, CASES) == [by_hand(text) for text in CASES]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(
            st.sampled_from(
                ["1", "23", "\n", "\n", "\n", "\r\n", "-->", "<i>", "</i>", "<", ">", " ", "a",
                 "\u00a0", "\u2009", "Bc", "-", "é", "\u00a0", "\ufeff", "\u0001", "♪", "\t", "--", "١"]
            ),
            max_size=14,
        ).map("".join),
        min_size=1,
        max_size=60,
    )
)
def test_random_texts(spark, texts):
    assert tokens_of(spark, texts) == [by_hand(text) for text in texts]


def first_seen(tokens):
    return list(dict.fromkeys(token.lower() for token in tokens if token.strip(WHITE)))


def test_distinct_words_by_text_and_by_scope(spark):
    df = spark.createDataFrame([("a", 0, SHORT), ("a", 1, "Neu guten\nTag")],
                               "film STRING, part INT, text STRING")
    per_text = text_words(df).orderBy("part", "rank").collect()
    assert [r.word for r in per_text if r.part == 0] == first_seen(by_hand(SHORT))
    assert [r.rank for r in per_text if r.part == 1] == [0, 1, 2]

    tokens = subtitle_tokens(df)
    words = distinct_words(tokens, ["part", "pos"], ["film"]).orderBy("part", "pos").collect()
    assert [r.word for r in words] == [
        "Guten", "Morgen", "Fräulein", "Maier-schmidt", "-", "Wie", "Gehts", "Tür", "Knallt",
        "Neu", "Tag",
    ]


def test_corpus_words_are_those_of_the_tokens(spark):
    texts = [SHORT, "Neu guten\nTag", "tag der TAG", "", "1\nweg\nda Tag"]
    df = spark.createDataFrame([("a" if at < 3 else "b", at, t) for at, t in enumerate(texts)],
                               "film STRING, part INT, text STRING").repartition(3)
    for scope in ([], ["film"]):
        got = corpus_words(df, ["part"], scope).orderBy("part", "rank").collect()
        want = distinct_words(subtitle_tokens(df), ["part", "pos"], scope)
        want = want.orderBy("part", "pos").collect()
        assert [(r.word, r.part) for r in got] == [(r.word, r.part) for r in want]


def test_capitalise(spark):
    df = spark.createDataFrame([("online-shop",), ("ßtraße",), ("élan",), ("x",)], "w STRING")
    got = [r[0] for r in df.select(capitalise(F.col("w"))).collect()]
    assert got == ["Online-shop", "SStraße", "Élan", "X"]


@pytest.mark.parametrize("limits", [{"broadcast_bytes": 0, "hot_rows": 2}, {}])
def test_remove_words_keeps_order_case_and_repeats(spark, limits):
    words = ["The", "cat", "THE", "Cat", "cat", "dog", "Dog", None, "cat"]
    df = spark.createDataFrame(list(enumerate(words)), "pos INT, word STRING")
    known = spark.createDataFrame([("CAT",), ("Bird",), (None,)], "w STRING")
    rows = remove_words(df, known, **limits).orderBy("pos").collect()
    assert [(r.pos, r.word) for r in rows] == [
        (at, w) for at, w in enumerate(words) if (w or "").lower() != "cat"
    ]


def test_deck_from_files(spark, tmp_path):
    (tmp_path / "one.srt").write_bytes(SHORT.encode())
    (tmp_path / "two.srt").write_bytes("1\r\n00:01 --> 00:02\r\nDie Tür\r\n".encode())
    known = spark.createDataFrame([("guten",), ("DIE",)], "w STRING")
    deck = deck_words(read_subtitles(spark, str(tmp_path)), known)
    rows = deck.orderBy("path", "rank").collect()
    assert [r.word for r in rows if r.path.endswith("two.srt")] == ["Tür"]
    assert [r.word for r in rows if r.path.endswith("one.srt")][:2] == ["Morgen", "Fräulein"]
    plan = deck._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_strip_white(spark):
    df = spark.createDataFrame([(" a\tb\r\nc\u00a0",)], "t STRING")
    assert df.select(strip_white(F.col("t"))).first()[0] == "abc\u00a0"


def test_open_tags_cost_linear_time(spark):
    """200,000 times ``<`` in a line, with and without a tag at its start and a ``>`` in the next line."""
    line = "<i>one</i> " + "<b two " * 200_000
    df = spark.createDataFrame([(line + "\n> three <u>four",)], "text STRING")
    began = time.monotonic()
    words = df.select(F.explode(split_words(clean_subtitle(F.col("text")))).alias("w")).groupBy("w").count().collect()
    assert time.monotonic() - began < 30
    assert {r.w: r["count"] for r in words} == {"one": 1, "b": 200_000, "two": 200_000, "three": 1, "four": 1}


def test_first_places_are_found_without_sorting_all_words(spark):
    values = [(high, low) for high in (None, -(1 << 63), -1, 0, (1 << 63) - 1) for low in (None, -(1 << 31), -1, 0, (1 << 31) - 1)]
    rows = [(*place, f"w{i}") for i in range(len(values)) for place in values[i:]]
    tokens = spark.createDataFrame(rows, "doc_id BIGINT, rank INT, token STRING")
    found = distinct_words(tokens, ["doc_id", "rank"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert found.schema.simpleString() == "struct<word:string,doc_id:bigint,rank:int>"
    assert {tuple(row) for row in found.collect()} == {(f"W{i}", *place) for i, place in enumerate(values)}
