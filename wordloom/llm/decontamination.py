"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a bounded run of documents inside a partition. Words that no benchmark item holds can't be
part of an occurrence, so they are end marks in the indexed text, and runs shorter than the shortest
phrase are left out. All phrases are searched backwards at once; their places become word spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import id_type, keyed_text, map_batches, rest_and_text, with_new_text
from wordloom.llm.fm_index import FmIndex
from wordloom.llm.words import WORD, ascii_words
from wordloom.session import stage

WINDOW_WORDS = 10
SHARD_SYMBOLS = 1_000_000  # indexed words of a shard
SHARD_BYTES = 16 << 20  # texts of a shard
BLOCK_WORDS = 200_000  # benchmark words sent to the tasks at once


class Phrases:
    """The windows of a block of benchmark items, as rows of word ids."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        windows: dict[tuple, set[int]] = {}
        for item, (_, words) in enumerate(items):
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1)):
                windows.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.items = [sorted(x) for x in windows.values()]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), max(map(len, windows), default=0)), np.int64)
        for row, ids in zip(self.rows, windows, strict=True):
            row[len(row) - len(ids) :] = ids
        self.shortest = int(self.lengths.min()) if len(windows) else 0


class Shard:
    """The indexable runs of some documents."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.runs: list[np.ndarray] = []
        self.docs: list[int] = []
        self.offsets: list[int] = []
        self.size = 0

    def add(self, doc: int, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.phrases.words.get, words, repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.phrases.shortest
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            self.runs.append(ids[a:b])
            self.docs.append(doc)
            self.offsets.append(a)
            self.size += b - a + 1

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and phrase of every occurrence."""
        if not self.runs:
            return (np.zeros(0, np.int64),) * 3
        end = np.zeros(1, np.int32)
        symbols = np.concatenate([x for run in self.runs for x in (run, end)])
        index = FmIndex(symbols, len(self.phrases.words) + 1)
        low, high = index.search(self.phrases.rows, self.phrases.lengths)
        counts = high - low
        phrase = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = index.locate(rows)
        begins = np.cumsum([0, *(len(r) + 1 for r in self.runs[:-1])])
        run = np.searchsorted(begins, places, "right") - 1
        return np.array(self.docs)[run], np.array(self.offsets)[run] + places - begins[run], phrase


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch made one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between those; a space is left in place."""
    places = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    for start, stop in spans:
        parts.append(text[at : places[start][0]])
        at = places[stop - 1][1]
    return " ".join([*parts, text[at:]]) if parts else text


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """Blocks of whole items of about ``block_words`` words, so that what is sent to the tasks is bounded."""
    rows = keyed_text(benchmark, item_col, text_col).select(F.col("id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    block, size = [], 0
    for row in rows.distinct().where("text is not null").toLocalIterator():
        words = ascii_words(bytes(row["text"]))
        if words:
            block.append((row["item"], words))
            size += len(words)
        if size >= block_words:
            yield Phrases(block, window)
            block, size = [], 0
    if block:
        yield Phrases(block, window)


SPANS = "array<struct<start:bigint,stop:bigint>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _scan(rows: DataFrame, phrases: Phrases, keep_text: bool, clean: bool) -> DataFrame:
    """One block of items against all rows of ``id, text, spans, items``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found_in(batch: pa.RecordBatch) -> pa.RecordBatch:
            shard, sizes, texts = Shard(phrases), [], batch.column(1).to_pylist()
            spans = [[(x["start"], x["stop"]) for x in found] for found in batch.column(2).to_pylist()]
            items = [set(x) for x in batch.column(3).to_pylist()]
            first = 0

            def settle(upto: int) -> None:
                for doc, start, phrase in zip(*(x.tolist() for x in shard.occurrences()), strict=True):
                    spans[doc].append((start, start + int(phrases.lengths[phrase])))
                    items[doc].update(phrases.names[i] for i in phrases.items[phrase] if phrases.names[i] is not None)
                for doc in range(first, upto):
                    spans[doc] = merged(spans[doc])

            for doc, text in enumerate(texts):
                words = ascii_words(text) if text else []
                sizes.append(len(words))
                shard.add(doc, words)
                if shard.size >= SHARD_SYMBOLS:
                    settle(doc + 1)
                    first, shard = doc + 1, Shard(phrases)
            settle(len(texts))
            columns = [batch.column(0)]
            if keep_text:
                columns.append(batch.column(1))
            if clean:
                cut = [x if x is None or not s else without_words(x.decode(), s).encode() for x, s in zip(texts, spans, strict=True)]
                columns.append(pa.array(cut, pa.binary()))
            columns += [pa.array(spans, _KIND), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in _shards(batches):
            yield found_in(batch)

    names = ["id", *["text"] * (keep_text or clean), "spans", "items", "n_words"]
    return map_batches(rows, work, f"id {id_type(rows)}, {'text binary, ' * (keep_text or clean)}spans {SPANS}, items array<string>, n_words bigint")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SHARD_BYTES`` of text."""
    for batch in batches:
        sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column(1)).to_pylist()])
        first = 0
        while first < batch.num_rows:
            limit = (sizes[first - 1] if first else 0) + SHARD_BYTES
            stop = max(first + 1, int(np.searchsorted(sizes, limit, "right")))
            yield batch.slice(first, stop - first)
            first = stop


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    block_words: int = BLOCK_WORDS,
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, n_words, spans, items`` and, with ``with_text``, ``cleaned``: one row per document.

    ``spans``: merged word spans (stop exclusive) that occurrences of an item's windows cover; ``items``: names
    of the items that occur, sorted as strings; ``cleaned``: the text without those spans. An item of fewer than ``window`` words
    is one window; null and empty items, like null and empty texts, have none. Items without a name count for spans
    only; repeated items and rows are taken as they are. An empty table gives no rows; without items nothing is hit. The benchmark is searched in blocks of ``block_words``
    words; every block but the last is a narrow pass whose rows are staged. No shuffle of documents, no limit on items or occurrences.
    """
    empty = F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items")
    rows = keyed_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    rows = rows.select("id", "text", *empty)
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_words)
    phrases, following = next(blocks, Phrases([], window)), next(blocks, None)
    while following:
        rows = stage(_scan(rows, phrases, keep_text=True, clean=False).drop("n_words"), "decontamination")
        phrases, following = following, next(blocks, None)
    rows = _scan(rows, phrases, keep_text=False, clean=with_text)
    columns = [F.col("id").alias("doc_id"), "n_words", "spans", "items"]
    return rows.select(*columns, *[F.col("text").cast("string").alias("cleaned")] * with_text)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars", window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` with cleaned texts; rows of which only removed spans are left go. Columns stay as they are.

    Null and empty texts stay, as rows without a hit do; repeated rows are cleaned each for itself. An empty table gives no
    rows, and an empty benchmark leaves all as they are.
    """
    found = decontaminate(rest_and_text(docs, text_col), benchmark, id_col="rest", window=window, with_text=True)
    hit = F.size("spans") > 0
    left = found.where(~hit | F.col("cleaned").rlike(WORD.pattern))
    return with_new_text(left, docs, text_col, "doc_id", F.col("cleaned"), hit, length_col)
