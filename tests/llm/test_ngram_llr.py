import math
import re
from collections import Counter

import pytest
import xxhash

from wordloom.llm.catalog.op03 import op3_quality_rules
from wordloom.llm.common import read_table
from wordloom.llm.ngram_llr import BINS, PRIOR, THRESHOLD, count_bins, quality_rules, with_base_rules

SF_DIR = "/root/testdata/sf0.001"


def base(text):
    """The counts as they are written down."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated), failed


def bins_of(text):
    pieces = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or "")
    spark_hash = lambda x, seed=42: xxhash.xxh64_intdigest(x.encode(), seed)
    signed = lambda x: (x - (1 << 64) if x >= 1 << 63 else x) % BINS
    single = [signed(spark_hash(p)) for p in pieces]
    return single + [signed(spark_hash(b, spark_hash(a))) for a, b in zip(pieces, pieces[1:], strict=False)]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in read_table(spark, SF_DIR, "documents").collect()}
    good = {r.doc_id for r in read_table(spark, SF_DIR, "labels").where("quality = 1").collect()}
    raw, trusted, bins = Counter(), Counter(), {d: bins_of(t) for d, t in docs.items()}
    for d, found in bins.items():
        raw.update(found)
        trusted.update(found if d in good else ())
    n, m = raw.total(), trusted.total()
    weight = {b: round(math.log((trusted[b] + PRIOR) / (raw[b] * m / n + PRIOR)), 6) for b in raw}
    rows = op3_quality_rules(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        expected = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected
        ratio = sum(weight[b] for b in bins[r.doc_id]) / max(1, len(bins[r.doc_id]))
        assert r.ratio == pytest.approx(ratio, abs=1e-9)
        assert r.kept == (not expected[-1] and r.ratio >= THRESHOLD)


def test_labels_are_told_apart(spark):
    found = op3_quality_rules(spark, "/root/testdata/sf0.01").join(read_table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    judged = found.where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0 and judged.where("quality = 0 and kept").count() == 0


CASES = [
    None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "a b c d e x a b c d e", "a " * 30, "a\nb\na\n\n\nb \nb ", "x\x0by\x0cz\r\nq",
    "é ü#ß *$% | <tag> & é", "a b\xa0c d", " ".join(f"w{i}" for i in range(200)), "one two three four five six " * 2 + " ".join(f"v{i}" for i in range(40)),
    " ".join(f"w{i % 7}" for i in range(60)), "_ __ a_b 1_2",
]


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(CASES)], "doc_id long, text string, words int, bins int")
    trusted = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    for r in quality_rules(docs, trusted).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(CASES[r.doc_id]), CASES[r.doc_id]


def test_rows(spark):
    text = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    found = quality_rules(docs, docs.select("doc_id").limit(0)).collect()
    assert sorted((str(r.doc_id), r.ratio, r.kept) for r in found) == [("1", 0.0, True)] * 2 + [("2", 0.0, False), ("None", 0.0, True)]
    assert quality_rules(docs.limit(0), docs).count() == 0


def test_a_long_text_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(100_000)) + " " + " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert quality_rules(docs, docs).first().n_repeat_words == 100
    assert quality_rules(docs, docs, threshold=0.0).first().kept  # the same documents on both sides: the ratio is 0


def test_every_trusted_document_is_counted(spark):
    """Also where the list is too long for a broadcast; rows without an id are counted, but never trusted."""
    docs = spark.range(25_000).selectExpr("if(id % 10 = 9, null, id) doc_id", "concat('word', id % 50, ' x') text")
    trusted = spark.range(25_000).selectExpr("if(id = 3, null, id) doc_id")
    whole, joined = ({r.bin: (r.n, r.n_trusted) for r in count_bins(docs, trusted, **more).collect()} for more in ({}, {"broadcast_bytes": 0}))
    assert sum(n for n, _ in whole.values()) == 3 * 25_000 and sum(t for _, t in whole.values()) == 3 * (25_000 - 2_500 - 1)
    assert joined == whole


def test_no_python_and_no_cross_join(spark):
    plan = op3_quality_rules(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan) and "Exchange" not in plan


def test_base_rules_do_not_go_through_texts_sign_by_sign(spark):
    """``translate`` and copied windows took most of the time; edges of white space, signs and windows stay as they are."""
    texts = ["", " ", None, "#", "a#*$%&|<>b#", "\x0b \x0c", "é ü ☃ 𝄞", "a b c d e", "a b c d", "\n \n\t\n x\nx\n x\nx", " x\t\n x\t\n", "a b c d e f " * 5, "w " * 30, "\x85  z\r\nz\r\n"]
    rows = with_base_rules(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    for r in rows.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.id]), r
    # ``slice`` is left where neighbours are compared, without windows in it.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "xxhash64(slice(" not in plan
