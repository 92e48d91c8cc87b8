import random

import numpy as np
import pytest

from wordloom.llm import decontamination
from wordloom.llm.decontamination import clean_documents, decontaminate, merged, without_words
from wordloom.llm.fm_index import FmIndex, WaveletTree, suffix_order
from wordloom.llm.words import ascii_words


def brute(docs, items, window=10):
    """Word spans and names by comparing every window at every place."""
    wanted = []
    for name, text in items:
        words = ascii_words((text or "").encode())
        if words:
            wanted += [(name, words[i : i + window]) for i in range(max(1, len(words) - window + 1))]
    out = []
    for text in docs:
        words = ascii_words((text or "").encode())
        hit, names = set(), set()
        for name, part in wanted:
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    names.add(name)
        out.append((len(words), hit, sorted(n for n in names if n is not None)))
    return out


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(0)
    for n, top in [(1, 1), (7, 1), (60, 3), (300, 40)]:
        symbols = np.append(rng.integers(0, top + 1, n), 0).astype(np.int32)
        ends = np.cumsum(symbols == 0)
        keys = [(0, e) if s == 0 else (s, 0) for s, e in zip(symbols.tolist(), ends.tolist())]
        assert suffix_order(symbols).tolist() == sorted(range(len(keys)), key=lambda i: keys[i:])
        tree = WaveletTree(symbols.astype(np.int64), top + 1)
        for s in range(top + 1):
            at = np.arange(len(symbols) + 1)
            assert tree.rank(np.full(len(at), s), at).tolist() == np.concatenate([[0], np.cumsum(symbols == s)]).tolist()
        assert tree.access(np.arange(len(symbols)))[0].tolist() == symbols.tolist()


def test_search_and_locate():
    rng = random.Random(3)
    for _ in range(60):
        top, n = rng.choice([1, 2, 5, 40]), rng.choice([1, 5, 50, 400])
        symbols = np.array([rng.randint(0, top) if rng.random() < 0.9 else 0 for _ in range(n)] + [0], np.int32)
        index = FmIndex(symbols, top + 1)
        phrases = [[rng.randint(1, top) for _ in range(rng.randint(1, 4))] for _ in range(20)]
        rows = np.zeros((20, 4), np.int64)
        for row, p in zip(rows, phrases, strict=True):
            row[4 - len(p) :] = p
        low, high = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(symbols)) if symbols[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


WORDS = "alpha beta gamma delta é42 zeta eta theta iota kappa lambda mu".split()


def fixture():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [("10", prose(30)), ("9", prose(10)), ("x", "Alpha, BETA"), (None, prose(14)), ("e", ""), ("n", None), ("9", prose(12)), ("s", "omega")]
    docs = [None, "", "...", "alpha", "x alpha-Beta y", items[0][1], "pre " + items[0][1].upper() + " post", prose(400)]
    docs += [f"{prose(20)}. {items[1][1]} {items[1][1]} {prose(5)}", items[3][1], " ".join(items[0][1].split()[5:20]), "omega " * 50]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(10**6, 10**6), (30, 10**6), (10**6, 12)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(decontamination, "SHARD_SYMBOLS", shard)
    docs, items = fixture()
    table = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate(table, benchmark, block_words=block, with_text=True).collect()}
    for i, (n, hit, names) in enumerate(brute(docs, items)):
        got = {k for s in found[i].spans for k in range(s.start, s.stop)}
        assert (found[i].n_words, got, found[i]["items"]) == (n, hit, names)
        assert [tuple(s) for s in found[i].spans] == merged([tuple(s) for s in found[i].spans])
        if docs[i] is None:
            assert found[i].cleaned is None
        else:
            left = ascii_words(found[i].cleaned.encode())
            words = ascii_words(docs[i].encode())
            assert left == [w for k, w in enumerate(words) if k not in hit]


def test_merge_and_cut():
    assert merged([(3, 5), (0, 2), (2, 3), (7, 9)]) == [(0, 5), (7, 9)]
    assert without_words("One, two-three (four) five!", [(1, 3)]) == "One,   (four) five!"
    assert without_words("One", [(0, 1)]) == " "


def test_clean_documents(spark):
    rows = [(1, "a b alpha beta c", "en", 16), (2, "Alpha beta!", "en", 11), (3, None, None, None), (4, "alpha", "de", 5), (4, "alpha", "de", 5), (5, "", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int")
    benchmark = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    clean = clean_documents(docs, benchmark)
    assert clean.schema == docs.schema
    found = sorted(map(str, map(tuple, clean.collect())))
    assert found == sorted(map(str, [(1, "a b   c", "en", 7), (3, None, None, None), (4, "alpha", "de", 5), (4, "alpha", "de", 5), (5, "", "x", 0)]))
    assert clean_documents(docs.limit(0), benchmark).count() == 0
    assert clean_documents(docs, benchmark.limit(0)).count() == 6


def test_a_passage_in_very_many_documents_and_a_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{passage} own{i}") for i in range(3000)] + [(3000, "w1 " * 200_000 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = decontaminate(docs, benchmark).collect()
    assert all(r["items"] == ["7"] and sum(s.stop - s.start for s in r.spans) == 12 for r in found)


def test_cleaning_keeps_null_and_empty_texts(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None, "s"), (2, "", "s"), (3, passage, "s"), (4, f"x {passage} y", "s"), (4, f"x {passage} y", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    items = spark.createDataFrame([("i", passage), (None, None)], "item_id string, text string")
    found = clean_documents(docs, items).collect()
    assert sorted((r.doc_id, r.text if r.text is None else r.text.split()) for r in found) == [
        (1, None), (2, []), (4, ["x", "y"]), (4, ["x", "y"])]
    assert clean_documents(docs.limit(0), items).count() == 0
    assert sorted(map(str, clean_documents(docs, items.limit(0)).collect())) == sorted(map(str, docs.collect()))
