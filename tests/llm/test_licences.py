import random
import re

import pytest

from wordloom.llm.catalog.op08 import op8_license_scan
from wordloom.llm.common import read_table
from wordloom.llm.rare_token_index import BASE_PHRASES, TEMPLATES, LicenceIndex, scan_licences, word_frequencies
from wordloom.llm.words import ascii_words

SF_DIR = "/root/testdata/sf0.001"


def words_of(text):
    """The words as they are written down."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def places(words):
    found = []
    for phrase, label in BASE_PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return sorted(found)


@pytest.fixture(scope="module")
def index():
    return LicenceIndex(TEMPLATES, BASE_PHRASES, {b"the": 900, b"under": 500, b"license": 50}, 1000, 8, 0.6)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("x Released under the MIT License. y", {"mit"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("Licensed under the GNU General Public License, version 2.", {"gpl-2.0"}),
        ("licensed under the GNU Affero General Public License version 3", {"agpl-3.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("Apache, MIT and general words about a public license", set()),
        ("under the MIT", set()),
        ("MIT License", set()),  # the base phrase alone is less than the notice
        ("", set()),
    ],
)
def test_notices(index, text, labels):
    assert set(index.notices(ascii_words(text.encode()))) == labels


def test_a_notice_at_the_very_start_and_end_of_a_text(index):
    """The template may hang over an end; its key phrase may not."""
    assert set(index.notices(ascii_words(b"under the MIT license"))) == {"mit"}
    assert set(index.notices(ascii_words(b"released under the MIT"))) == set()


MIT_PARAGRAPH = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def test_several_notices_in_one_long_text():
    """Words of one notice, or of the prose, don't take the places of another's."""
    common = {w.encode(): 400 for w in "licensed under the apache license version 2 0".split()}
    index = LicenceIndex(TEMPLATES, BASE_PHRASES, common, 1000, 8, 0.6)
    prose = "any person may copy the source or binary forms and use modification charge purpose domain creative commons " * 8_000
    text = f"{prose}{MIT_PARAGRAPH}. {prose} Licensed under the Apache License, Version 2.0. {prose}"
    assert index.notices(ascii_words(text.encode())) == {"mit": 1.0, "apache-2.0": 1.0}


def test_notices_against_every_place(index):
    """With words changed and cut: the same as a comparison at every place."""
    draw = random.Random(7)
    vocabulary = sorted(index.vocabulary)
    labelled = 0
    for _ in range(300):
        words = []
        for label, template, _ in draw.sample(index.templates, 3):
            words += draw.choices(vocabulary, k=draw.randrange(12))
            words += [w if draw.random() < 0.8 else draw.choice(vocabulary) for w in template]
        expected = {}
        for label, template, keys in index.templates:
            for at in range(-len(template), len(words)):
                window = words[max(at, 0) : max(at + len(template), 0)]
                share = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(template)) / len(template)
                inside = all(any(window[i : i + len(k)] == k for i in range(len(window))) for k in keys)
                if share >= 0.6 and inside:
                    expected[label] = max(share, expected.get(label, 0))
        assert index.notices(words) == expected
        labelled += len(expected)
    assert labelled > 100


def test_frequencies_count_all_rows(spark):
    docs = read_table(spark, SF_DIR, "documents")
    found = {bytes(r["word"]).decode(): r["n_docs"] for r in word_frequencies(docs, [b"the", b"license"]).collect()}
    sets = [set(words_of(r.text)) for r in docs.collect()]
    assert found == {"": len(sets), "the": sum("the" in s for s in sets), "license": sum("license" in s for s in sets)}


def test_query(spark):
    texts = {r.doc_id: words_of(r.text) for r in read_table(spark, SF_DIR, "documents").collect()}
    labelled = 0
    for r in op8_license_scan(spark, SF_DIR).collect():
        found = places(texts[r.doc_id])
        starts = [p[0] for p in found]
        assert (r.n_words, r.n_base) == (len(texts[r.doc_id]), len(found))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if found else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert bool(found) == (r.score > 0)
        labelled += bool(found)
    assert labelled


def test_rows(spark):
    rows = [(1, "the MIT License and the mit license", "s"), (1, "the MIT License and the mit license", "s"), (None, None, None), (2, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    found = sorted((str(r.doc_id), r.n_words, [tuple(p) for p in r.places]) for r in scan_licences(docs).collect())
    assert found == [("1", 7, [(1, "mit"), (5, "mit")])] * 2 + [("2", 0, []), ("None", 0, [])]
    assert scan_licences(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000 + "apache license")], "doc_id long, text string")
    assert scan_licences(long).first().places[0].start == 300_000
