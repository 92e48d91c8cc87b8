"""Whole texts to token ids, with each distinct piece of a text encoded once.

A piece ends where the tokenizer always ends a word: before a space or newline, and between a letter
and a sign. So the ids of a text are those of its pieces, one after the other, and each worker keeps
the ids of the pieces it has seen. Of a block of texts each distinct piece is looked up once. Texts in which that is not certain (other white space, special tokens' strings, a tokenizer of
another make) are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa

from wordloom.llm.common import kept

CACHED_PIECES = 800_000  # per worker; of a full table only the first pieces stay
KEPT_SHARE = 0.75  # pieces seen early are the frequent ones
ENCODED_AT_ONCE = 2_000

#: The letters by which byte-level vocabularies write bytes. Printable ones stand for themselves, the
#: others in their order for U+0100 and what follows.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _PRINTABLE]
BYTE_LETTERS = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(_HIDDEN)})
LAST_LATIN = "\u024f"
_SPACE = BYTE_LETTERS[ord(" ")]
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGNS = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


class PieceTable:
    """Ids of the pieces seen, in one flat array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.add([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def trim(self, keep: int) -> None:
        """Forget all but the first ``keep`` pieces."""
        self.slots = dict(islice(self.slots.items(), keep))
        self.starts = self.starts[: max(len(self.slots) + 1, 2)].copy()
        self.flat = self.flat[: max(int(self.starts[len(self.slots)]), 1)].copy()

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """``ids``: those of all the pieces in a row, ``sizes`` of them for each."""
        slot = len(self.slots)
        start = self.starts[slot]
        while slot + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while start + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[start : start + len(ids)] = ids
        self.starts[slot + 1 : slot + 1 + len(pieces)] = start + np.cumsum(sizes)
        self.slots.update(zip(pieces, range(slot, slot + len(pieces)), strict=True))

    def ids(self, slots: np.ndarray | list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in these slots in a row, and how many each has."""
        slots = np.asarray(slots, np.int64)
        first = self.starts[slots]
        sizes = self.starts[slots + 1] - first
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(first - before, sizes) + np.arange(sizes.sum())], sizes


class TextEncoder:
    """Encodes texts with a tokenizer file of the tokenizers library; special tokens' strings are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.kind = self._kind(json.load(file))
        self.table = PieceTable()
        if self.kind == "bytes":
            self.newline = self.whole("\n")
            self.kind = "bytes" if len(self.newline) == 1 else ""

    @staticmethod
    def _kind(made: dict) -> str:
        """``bytes``: white space stays and leads a word; ``words``: white space is dropped."""
        before, normalizer = made.get("pre_tokenizer") or {}, made.get("normalizer")
        if made.get("model", {}).get("type") != "BPE" or made.get("truncation") or made.get("padding"):
            return ""
        if before.get("type") == "ByteLevel" and not normalizer:
            return "bytes" if before.get("use_regex") and not before.get("add_prefix_space") else ""
        steps = [x.get("type") for x in before.get("pretokenizers", [])]
        names = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
        if steps == ["Split", "ByteLevel"] and names == ["NFC", "Replace", "Lowercase"]:
            split = before["pretokenizers"][0]
            dropped = split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
            return "words" if dropped else ""
        return ""

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def certain(self, text: str) -> bool:
        """Whether the tokenizer surely ends words where ``pieces`` cuts the text."""
        # Not printable are white space but the space, controls and invisible signs; "<|" may begin a special token.
        if not self.kind or "<|" in text or not text.replace("\n", "").isprintable():
            return False
        return self.kind == "words" or not ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n"))

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of texts that are certain, the place among them of each piece, and how many each text has."""
        texts_bytes = [x.encode() for x in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in texts_bytes])]).astype(np.int64)
        joined = b"".join(texts_bytes)
        signs = np.frombuffer(joined, np.uint8)
        newline = signs == 10
        first = (signs == 32) | newline
        first[1:] |= newline[:-1] | (_LETTERS[signs[:-1]] & _SIGNS[signs[1:]])
        first[starts[starts < len(signs)]] = True
        cuts = np.append(np.flatnonzero(first), len(signs)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(joined)).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "words":
            distinct = [x.strip() for x in distinct]
        return distinct, found.indices.to_numpy(), np.diff(np.searchsorted(cuts, starts))

    def one_word(self, piece: str) -> str | None:
        """A piece of Latin letters only, which is one word to the tokenizer, as its model reads it; else None."""
        if self.kind == "words":
            return piece.lower() if piece.isascii() and piece.isalpha() else None
        letters = piece[1:] if piece[0] == " " else piece
        if piece.isascii():
            return piece.replace(" ", _SPACE) if letters.isalpha() else None
        return piece.encode().decode("latin-1").translate(BYTE_LETTERS) if letters.isalpha() and max(letters) <= LAST_LATIN else None

    def learn_words(self, pieces: list[str]) -> list[str]:
        """Add the ids of the pieces that are one word each, straight from the model; gives the others."""
        split, words, others = self.tokenizer.model.tokenize, {}, []
        for piece in pieces:
            word = self.one_word(piece)
            if word is None:
                others.append(piece)
            else:
                words[piece] = [token.id for token in split(word)]
        sizes = np.fromiter(map(len, words.values()), np.int64, len(words))
        self.table.add(list(words), np.fromiter(chain.from_iterable(words.values()), np.uint32, int(sizes.sum())), sizes)
        return others

    def learn(self, pieces: set[str]) -> None:
        """Add the ids of pieces that are not in the table."""
        new = list(pieces.difference(self.table.slots))
        for special in [x for x in new if x.isspace() or x[0] == "\0"]:
            ids = self.whole(special) if special[0] != "\0" else np.array([int(special[1:])], np.uint32)
            self.table.add([special], ids, np.array([len(ids)]))
        new = [x for x in new if not x.isspace() and x[0] != "\0"]
        new = [x for at in range(0, len(new), ENCODED_AT_ONCE) for x in self.learn_words(new[at : at + ENCODED_AT_ONCE])]
        for at in range(0, len(new), ENCODED_AT_ONCE):
            block = new[at : at + ENCODED_AT_ONCE]
            if self.kind == "bytes":  # one call for all: the newline's token stands alone, between the pieces
                ids = self.whole("\n".join(block))
                cuts = np.concatenate([[-1], np.flatnonzero(ids == self.newline[0]), [len(ids)]])
                self.table.add(block, ids[ids != self.newline[0]], np.diff(cuts) - 1)
            else:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(block, add_special_tokens=False)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                self.table.add(block, np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum()), sizes)

    def _slots(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.table.slots.get, pieces, repeat(-1)), np.int64, len(pieces))

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text starts (one more than texts); ``end`` closes each text."""
        closing = [] if end is None else [f"\0{end}"]
        sure = [self.certain(x) for x in texts]
        distinct, places, counts = self.pieces([x for x, known in zip(texts, sure, strict=True) if known])
        distinct += closing
        slots = self._slots(distinct)
        if len(self.table.slots) + int((slots < 0).sum()) > CACHED_PIECES and len(self.table.slots) > CACHED_PIECES * KEPT_SHARE:
            self.table.trim(int(CACHED_PIECES * KEPT_SHARE))
            slots = self._slots(distinct)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            lost = [distinct[i] for i in missing.tolist()]
            self.learn(set(lost))
            slots[missing] = self._slots(lost)
        lasts = np.cumsum(counts)
        every = slots[places]
        if closing:
            every, counts = np.insert(every, lasts, slots[-1]), counts + 1
        ids, sizes = self.table.ids(every)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        lengths = np.diff(edges)
        if not all(sure):
            parts = iter([ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
            last = np.array([] if end is None else [end], np.uint32)
            parts = [next(parts) if known else np.append(self.whole(x), last) for x, known in zip(texts, sure, strict=True)]
            ids, lengths = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids.astype(np.uint32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def encoder_key(path: str) -> tuple:
    return ("encoder", path)


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for that file: made once, kept between the tasks of an operator."""
    return kept(encoder_key(path), lambda: TextEncoder(path))


def text_blocks(texts: list[str], most: int = 2_000_000) -> Iterator[range]:
    """Ranges of texts of about ``most`` characters, so that memory does not follow the batch."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield range(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))
