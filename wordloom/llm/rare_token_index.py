"""Licence notices by a positional index of rare words.

The words of the licence templates get their document frequency over the whole corpus. Each template
has postings of its rarest words, so many that wherever enough of its words stand in their places some
of these do as well. Postings that agree on the distance between file and template place the template in
the file. A template counts where enough of its words stand in their places and its key phrases stand inside.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import id_type, map_batches, pick
from wordloom.llm.words import ascii_words

RARE_WORDS = 8  # words of a template that have postings, or more where the share needs them
VOTES = 2
PLACES_AT_ONCE = 1 << 16  # words of a file whose votes are held at once
MIN_SHARE = 0.6

# Short public notices of licences, and the phrases that each must hold. One label may have several.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("general public license", "version 3")),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license version 3",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license version 3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class LicenceIndex:
    """Postings of the templates' words, with the words' weights."""

    def __init__(self, templates, phrases, frequencies: dict[bytes, int], n_docs: int, rare_words: int, min_share: float) -> None:
        self.templates = [(label, ascii_words(text.encode()), [ascii_words(k.encode()) for k in keys]) for label, text, keys in templates]
        self.phrases = [(ascii_words(p.encode()), label) for p, label in phrases]
        self.firsts = frozenset(p[0] for p, _ in self.phrases)
        self.min_share = min_share
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) for _, words, _ in self.templates for w in words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes: list[int] = []
        for t, (_, words, _) in enumerate(self.templates):
            # Where ``least`` words stand in place, at most the others do not: so many and the votes have postings.
            least = next((n for n in range(1, len(words)) if n / len(words) >= min_share), len(words))
            self.votes.append(min(VOTES, least))
            places = sorted(range(len(words)), key=lambda p: (-self.idf[words[p]], words[p], p))
            for place in places[: max(rare_words, len(words) - least + self.votes[t])]:
                self.postings[words[place]].append((t, place))
        self.longest = max((len(words) for _, words, _ in self.templates), default=0)
        self.vocabulary = frozenset(self.postings)

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """``(start, label)`` of every place where a phrase stands."""
        if self.firsts.isdisjoint(words):
            return []
        return [
            (i, label)
            for phrase, label in self.phrases
            for i, w in enumerate(words)
            if w == phrase[0] and words[i : i + len(phrase)] == phrase
        ]

    def notices(self, words: list[bytes]) -> dict[str, float]:
        """Label and share of the template's words, of each template that stands in the words."""
        found: dict[str, float] = {}
        if self.vocabulary.isdisjoint(words):
            return found
        for low in range(-self.longest, len(words), PLACES_AT_ONCE):
            self._place(words, low, low + PLACES_AT_ONCE, found)
        return found

    def _place(self, words: list[bytes], low: int, high: int, found: dict[str, float]) -> None:
        """Add the templates that begin at ``low`` or later and before ``high``."""
        votes: Counter = Counter()
        begin = max(low, 0)
        for i, word in enumerate(words[begin : high + self.longest], begin):
            if word in self.vocabulary:
                for t, place in self.postings[word]:
                    if low <= i - place < high:
                        votes[t, i - place] += 1
        for (t, at), n in votes.items():
            label, template, keys = self.templates[t]
            if n < self.votes[t] or found.get(label, 0) >= 1:
                continue
            window = words[max(at, 0) : at + len(template)]
            share = sum(map(bytes.__eq__, window, template[max(-at, 0) :])) / len(template)
            if share >= self.min_share and share > found.get(label, 0) and all(_holds(window, k) for k in keys):
                found[label] = share


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def word_frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> DataFrame:
    """``word, n_docs``: in how many rows each word of the vocabulary occurs; the empty word counts all rows."""
    known = frozenset(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts[b""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(known.intersection(ascii_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = pick(docs, text=text_col).select(F.col("text").cast("string").cast("binary").alias("text"))
    return map_batches(rows, work, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n_docs"))


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    phrases=BASE_PHRASES,
    rare_words: int = RARE_WORDS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """``doc_id, n_words, places, notices``: one row per document.

    ``places``: every place of a base phrase as ``(start, label)``, by start. ``notices``: labels of the templates found with
    the share of their words that stand in place. Two passes over the texts; between them only the frequencies of
    the templates' words (a few hundred at most) come together. Null and empty texts have no words; repeated rows
    are scanned each for itself; an empty table gives no rows; other columns are not read. A template's rarest words are chosen by (frequency, word, place).
    No notice is lost for others in the same text or for its length: each template has postings of its own.
    """
    vocabulary = sorted({w for _, text, _ in templates for w in ascii_words(text.encode())})
    counted = {bytes(r["word"]): r["n_docs"] for r in word_frequencies(docs, vocabulary, text_col).collect()}
    index = LicenceIndex(templates, phrases, counted, counted.get(b"", 0), rare_words, min_share)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string").cast("binary"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        notices_type = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            sizes, places, notices = [], [], []
            for text in batch.column(1).to_pylist():
                words = ascii_words(text) if text else []
                sizes.append(len(words))
                places.append(sorted(index.base(words)))
                notices.append(sorted(index.notices(words).items()))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, places_type), pa.array(notices, notices_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "places", "notices"])

    types = "n_words bigint, places array<struct<start:bigint,label:string>>, notices array<struct<label:string,share:double>>"
    return map_batches(rows, work, f"doc_id {id_type(rows, 'doc_id')}, {types}")
