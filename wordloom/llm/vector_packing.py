"""Packing of token pieces into sequences as vector bins.

Every piece has three sizes: tokens, one segment, and loss-bearing tokens. A sequence has a limit for
each. An open sequence takes, of the pieces that fit, the one whose sizes have the largest dot product
with the room that is left, each divided by its limit. Tokens longer than a sequence are cut into full
ones first. Where nothing fits, a piece is cut to fill the room; so a sequence only ends short when its
segments or loss tokens are used up. It then gives back what lies beyond a power of two, a length that
needs no padding. The last tokens of a partition go to sequences of such lengths too.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import id_type, map_batches, pick
from wordloom.llm.tokenizing import encoder, encoder_key, text_blocks

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS = 2048, 64, 2048
WINDOW_TOKENS = 2_000_000  # pieces that wait at once, in tokens
MOST_PADDING = 1 / 128  # of a sequence that ends short and is padded all the same


class Packer:
    """Packs one partition, piece by piece; waiting pieces are bounded by ``window`` tokens."""

    def __init__(self, limits: tuple[int, int, int], first_id: int, window: int = WINDOW_TOKENS) -> None:
        self.limits, self.next_id, self.window = limits, first_id, window
        self.by_size: dict[tuple[int, int], deque] = {}  # (tokens, loss tokens): the pieces of those sizes
        self.sizes: list[tuple[int, int]] = []
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, doc: int, start: int, length: int, loss_from: int) -> None:
        """Tokens ``start`` to ``start + length`` of a document, of which those from ``loss_from`` on bear loss."""
        most, _, most_loss = self.limits
        while length:
            size = min(length, most)
            loss = self._loss(start, size, loss_from)
            if loss > most_loss:
                size, loss = size - (loss - most_loss), most_loss
            if size == most and loss <= most_loss:
                self.out.append((doc, start, size, self._new(), 0))
            else:
                self._wait(doc, start, size, loss_from)
            start, length = start + size, length - size
        if self.waiting >= self.window:
            self.pack(keep=self.window // 2)

    @staticmethod
    def _loss(start: int, size: int, loss_from: int) -> int:
        return min(size, max(0, start + size - loss_from))

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _wait(self, doc: int, start: int, size: int, loss_from: int) -> None:
        key = (size, self._loss(start, size, loss_from))
        if key not in self.by_size:
            self.by_size[key] = deque()
            insort(self.sizes, key)
        self.by_size[key].append((doc, start, size, loss_from))
        self.waiting += size

    def _take(self, key: tuple[int, int]) -> tuple:
        queue = self.by_size[key]
        piece = queue.popleft()
        if not queue:
            del self.by_size[key]
            del self.sizes[bisect_right(self.sizes, key) - 1]
        self.waiting -= piece[2]
        return piece

    def _best(self, room: tuple[int, int, int]) -> tuple[int, int] | None:
        """Of the sizes that fit, that with the largest dot product of sizes and room; ties: more tokens, then more loss."""
        limits = self.limits
        weights = [r / (limit * limit) for r, limit in zip(room, limits, strict=True)]
        best, most = None, -1.0
        for at in range(bisect_right(self.sizes, (room[0], room[2])) - 1, -1, -1):
            tokens, loss = self.sizes[at]
            if tokens * (weights[0] + weights[2]) + weights[1] <= most:
                break  # a piece bears at most all of its tokens as loss: no smaller one can do better
            if loss <= room[2] and tokens <= room[0] and (product := tokens * weights[0] + weights[1] + loss * weights[2]) > most:
                best, most = (tokens, loss), product
        return best

    def pack(self, keep: int = 0) -> None:
        """Fill sequences until at most ``keep`` tokens wait."""
        while self.waiting > keep:
            sequence, room, offset, bears = self._new(), self.limits, 0, []
            if self.waiting < room[0]:  # the last tokens of a partition: lengths that are powers of two need no padding
                room = (1 << (self.waiting.bit_length() - 1), *room[1:])
            while min(room[:2]) and self.sizes:
                key = self._best(room)
                if key is None:
                    # Nothing fits: cut the smallest piece to the room, unless its tokens all bear loss and no loss is left.
                    key = self.sizes[0]
                    doc, start, size, loss_from = self._take(key)
                    part = min(size, room[0])
                    while part and self._loss(start, part, loss_from) > room[2]:
                        part -= self._loss(start, part, loss_from) - room[2]
                    if part < size:
                        self._wait(doc, start + part, size - part, loss_from)
                    if not part:
                        break
                else:
                    doc, start, part, loss_from = self._take(key)
                self.out.append((doc, start, part, sequence, offset))
                bears.append(loss_from)
                offset += part
                room = (room[0] - part, room[1] - 1, room[2] - self._loss(start, part, loss_from))
            if offset < self.limits[0] * (1 - MOST_PADDING):
                self._give_back(offset - (1 << (offset.bit_length() - 1)), bears)

    def _give_back(self, tokens: int, bears: list[int]) -> None:
        """Let the last ``tokens`` placed wait again; ``bears``: where the loss of each piece of the sequence begins."""
        while tokens:
            doc, start, size, sequence, offset = self.out.pop()
            part = min(size, tokens)
            if part < size:
                self.out.append((doc, start, size - part, sequence, offset))
            self._wait(doc, start + size - part, part, bears.pop())
            tokens -= part

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end: int | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from_col: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int = MAX_LOSS_TOKENS,
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: one row per piece.

    ``ids``: the piece's token ids as little-endian 32-bit integers. ``end`` closes every document.
    ``loss_from_col``: the first token of a document that bears loss (its prompt's length); without it all do.
    Each partition fills its own sequences, in one pass with bounded waiting pieces, so there is no shuffle and a
    hot source needs no care; at most the last sequences of a partition are short. Null texts are empty and hold
    the end id; without ``end`` an empty document has no piece. Repeated rows are packed each for itself;
    an empty table gives no rows; other columns are not read.
    """
    named = pick(docs, id=id_col, text=text_col, **({"loss_from": loss_from_col} if loss_from_col else {}))
    loss = F.coalesce(F.col("loss_from").cast("long"), F.lit(0)) if loss_from_col else F.lit(0)
    rows = named.select("id", F.col("text").cast("string").alias("text"), loss.cast("long").alias("loss_from"))
    limits = (max_tokens, max_segments, max_loss_tokens)
    if min(limits) < 1:
        raise ValueError("limits are at least 1")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        held: dict[int, tuple] = {}  # of documents with pieces that wait: id, ids, tokens not yet placed
        number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = packer.taken()
            for at in range(0, len(found), 2000):
                block = found[at : at + 2000]
                columns = [[], [], [], [], [], [], []]
                for doc, start, length, sequence, offset in block:
                    key, ids, left = held[doc]
                    for values, value in zip(columns, (key, start, length, ids[start : start + length].tobytes(), len(ids), sequence, offset), strict=True):
                        values.append(value)
                    if left == length:
                        del held[doc]
                    else:
                        held[doc] = (key, ids, left - length)
                arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(columns[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        kind = pa.int64()
        for batch in batches:
            keys, texts, loss_from = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            kind = batch.column(0).type
            for block in text_blocks(texts):
                ids, starts = encode(texts[block.start : block.stop], end)
                for i, a, b in zip(block, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if b > a:
                        held[number] = (keys[i], ids[a:b].astype("<u4"), b - a)
                        packer.add(number, 0, b - a, loss_from[i])
                        number += 1
                yield from flush()
        packer.pack()
        yield from flush()

    types = f"doc_id {id_type(rows)}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return map_batches(rows, work, types, encoder_key(tokenizer))
