import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm.stripes import collocations, count_pairs, count_stripes, local_stripes, phrase_filter, slices

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_count, max_words, kept=2000):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    out = {}
    good = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= min_count}
    inside = {
        (lang, w[i:j])
        for (lang, w), n in good.items()
        for i in range(len(w))
        for j in range(i + 1, len(w) + 1)
        if j - i < len(w) and counts[lang, w[i:j]] == n
    }
    for (lang, w), a in good.items():
        if (lang, w) in inside:
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -score)
        for lang, rows in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:kept], 1)
    )


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "dé", "E", "x y", "z\x00", "Ä", "new", "York", "city"]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 30)):
            parts.append(rnd.choice(words) if rnd.random() < 0.6 else "new York City hall")
            parts.append(rnd.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " : "]) if rnd.random() < 0.3 else " ")
        docs.append((rnd.choice(["en", "en", "de", None, "", "und"]), "".join(parts)))
    return [*docs, ("en", None), (None, ""), ("de", " .,;"), ("en", "new york"), ("en", "new york")]


def mined(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


@pytest.mark.parametrize(("seed", "min_count", "max_words"), [(1, 5, 5), (2, 3, 3), (3, 20, 2), (4, 2, 7)])
def test_same_as_brute_force(spark, seed, min_count, max_words):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "lang STRING, text STRING").repartition(3)
    assert mined(df, min_count=min_count, max_words=max_words) == brute(docs, min_count, max_words)


def test_a_full_filter_changes_nothing(spark):
    docs = corpus(5) + [("en", " ".join(f"w{i} w{i + 1}" for i in range(4000))) for _ in range(4)]
    df = spark.createDataFrame(docs, "lang STRING, text STRING").repartition(3)
    assert mined(df, min_count=4, filter_bits=1 << 15) == brute(docs, 4, 5)


@pytest.mark.parametrize(("slice_bytes", "known_words"), [(64, 3), (64, 1 << 19), (4 << 20, 3)])
@pytest.mark.parametrize("level", [1, 2, 3, 5])
def test_long_texts_go_on_from_slice_to_slice(slice_bytes, known_words, level):
    text = "new york city hall " * 50 + "x" * 300 + " " + "one two. three " * 40 + "end"
    assert b" ".join(slices(text.encode(), 64)) == text.encode()
    assert all(len(x) <= 64 or b" " not in x for x in slices(text.encode(), 64))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en", "de"], "text": [text, text.replace(" ", ". "), text, "one two three"]})

    def added(*limits):
        total = Counter()
        for found in count_stripes(iter([batch, batch]), level, None, None, None, *limits):
            for r in found.to_pylist():
                total.update({(r["lang"], x["prefix"], word): n for x in r["stripes"] for word, n in x["stripe"]})
        return total

    counts = added(slice_bytes, known_words)
    assert counts == added() and counts
    want = Counter()
    for lang, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for piece in whole.split("."):
            words = [*piece.split(), ""]
            for j in range(level - 1, len(words) - (level == 1)):
                want[lang, " ".join(words[j - level + 1 : j]), words[j]] += 2
    assert counts == want


@pytest.mark.parametrize("limits", [(), (64, 3)])
def test_pair_counts_add_up(limits):
    text = "new york city hall " * 50 + "one two. three " * 40
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": [text, text, "one two three"]})
    cells = Counter()
    for found in count_pairs(iter([batch]), b"\xff" * 4096, *limits):
        for r in found.to_pylist():
            for low, n in zip(r["lows"], r["counts"], strict=True):
                cells[r["bucket"], low] += n
    pairs = Counter()
    for lang, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for piece in whole.split("."):
            words = piece.split()
            pairs.update((lang, *pair) for pair in zip(words, words[1:], strict=False))
    assert sorted(cells.values()) == sorted(pairs.values())


def test_stripes_add_up_to_their_prefix(spark):
    docs = [("en", "a b a c. a b a"), ("en", "a")]
    df = spark.createDataFrame(docs, "lang STRING, text STRING").coalesce(1)
    allowed = phrase_filter(spark.createDataFrame([("en", "a"), ("en", "b")], "lang STRING, phrase STRING"), 1)
    found = {}
    for r in local_stripes(df, 2, allowed).collect():
        for x in r.stripes:
            found.setdefault(x.prefix, {}).update(x.stripe)
    assert found == {"a": {"b": 2, "": 3}, "b": {"a": 2}}


def test_stripes_without_rests_keep_what_follows(spark):
    docs = [("en", "a b a c. a b a"), ("en", "a")]
    df = spark.createDataFrame(docs, "lang STRING, text STRING").coalesce(1)
    allowed = phrase_filter(spark.createDataFrame([("en", "a"), ("en", "b")], "lang STRING, phrase STRING"), 1)
    found = {x.prefix: x.stripe for r in local_stripes(df, 2, allowed, rests=False).collect() for x in r.stripes}
    assert found == {"a": {"b": 2}, "b": {"a": 2}}


def test_rare_words_send_no_stripes_on(spark):
    allowed = phrase_filter(spark.createDataFrame([("en", "a"), ("en", "b")], "lang STRING, phrase STRING"), 1)
    texts = [f"a b rare{i} rarer{i} a b " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50, "text": texts})
    found = [x for rows in count_stripes(iter([batch]), 2, allowed, slice_bytes=64, known_words=30, rests=False) for r in rows.to_pylist() for x in r["stripes"]]
    assert [(x["prefix"], x["stripe"]) for x in found] == [("a", [("b", 100)])]


def test_stripes_do_not_grow_with_the_pieces_of_the_input(spark, monkeypatch):
    import wordloom.llm.stripes as s

    docs = corpus(7, 400)
    df = spark.createDataFrame(docs, "lang STRING, text STRING").repartition(64)
    counted, plain = [], s.local_stripes
    monkeypatch.setattr(s, "local_stripes", lambda rows, *a, **k: counted.append(rows.rdd.getNumPartitions()) or plain(rows, *a, **k))
    assert mined(df, min_count=5) == brute(docs, 5, 5)
    assert counted and max(counted) <= s.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 64


def test_best_of_each_language(spark):
    docs = corpus(6, 200)
    df = spark.createDataFrame(docs, "lang STRING, text STRING")
    assert mined(df, min_count=2, kept=3) == brute(docs, 2, 5, 3)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "lang STRING, text STRING")
    assert collocations(empty).collect() == []
    docs = [("en", "to be. To be, or", 1)] * 60 + [(None, "to be", 2)] * 100
    df = spark.createDataFrame(docs, "prefix STRING, next STRING, n INT").withColumn("part", F.lit(1)).withColumn("stripe", F.lit(2))
    want = brute([d[:2] for d in docs], 100, 5)
    assert mined(df, lang_col="prefix", text_col="next") == want and len(want) == 2


def test_wide_products_are_exact(spark):
    docs = [("en", "a b " * 3000 + "c d " * 2000)] * 2
    df = spark.createDataFrame(docs, "lang STRING, text STRING")
    assert mined(df) == brute(docs, 100, 5)


def test_wrong_parameters(spark):
    df = spark.createDataFrame([], "lang STRING, text STRING")
    for wrong in ({"max_words": 1}, {"min_count": 0}, {"filter_bits": 100_000}):
        with pytest.raises(ValueError):
            collocations(df, **wrong)
