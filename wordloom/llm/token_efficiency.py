"""Secrets in texts: patterns, and random strings found by their token efficiency.

Words of a language need few tokens for many characters; random strings need many. A run of letters
and digits whose characters per token stay below a ratio is reported, unless it is a digest of a known
length, a UUID, or an identifier made of short parts that are mostly words and plain numbers. A run without
a digit may be a long word or a name of joined words: it must stay below a lower ratio, in small letters as
well, hold many different letters and a long part. Of a run that a pattern covers in part the rest is
reported, unless that is words and numbers.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import accumulate, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import id_type, kept, keyed_text, map_batches, rest_and_text, with_new_text

KINDS = ("assign", "access", "hex", "random")
MAX_CHARS_PER_TOKEN = 2.2
LETTERS_SHARE = 10 / 11  # of that ratio, for runs without a digit
MIN_LETTERS = 8  # different ones in a run without a digit; sequences over a small alphabet hold fewer
MIN_RANDOM_CHARS, MIN_PART_CHARS = 20, 16
REDACTED = "[redacted]"

#: Letters of the names in either case, ASCII only.
_NAMES = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # the runs of 32 and more are the runs that don't fail
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM_CHARS},}}")
SIGNS = re.compile("[_/=+-]+")
DIGEST = re.compile("(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
UUID = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


class RandomStrings:
    """Finds runs that a tiktoken vocabulary can't shorten."""

    def __init__(self, vocabulary: str, pattern: str, max_chars_per_token: float) -> None:
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ratio = max_chars_per_token

    def is_random(self, run: str) -> bool:
        if not re.search("[A-Za-z]", run):
            return False
        if not re.search("[0-9]", run):
            return self.is_random_letters(run)
        if DIGEST.fullmatch(run) or UUID.fullmatch(run):
            return False
        if max(map(len, SIGNS.split(run))) < MIN_PART_CHARS and self.is_plain(run):
            return False  # an identifier or a path
        return len(run) < self.ratio * len(self.encode(run))

    def is_random_letters(self, run: str) -> bool:
        """For a run without a digit: capitals are taken as small letters too, since few words in capitals have tokens."""
        small = run.lower()
        if max(map(len, SIGNS.split(run))) < MIN_PART_CHARS or len({x for x in small if x.isalpha()}) < MIN_LETTERS:
            return False
        if 2 * sum(ord(b) - ord(a) == 1 for a, b in pairwise(small)) >= len(small):
            return False  # an alphabet
        ratio = self.ratio * LETTERS_SHARE
        return len(run) < ratio * len(self.encode(run)) and len(run) < ratio * len(self.encode(small))

    def is_plain(self, run: str) -> bool:
        """Whether at least half of the letters and digits are in words and plain numbers between the signs."""
        parts = [p for p in SIGNS.split(run) if p]
        return 2 * sum(len(p) for p in parts if self.is_word(p)) >= sum(map(len, parts))

    def is_word(self, part: str) -> bool:
        n = len(self.encode(part))
        return part.isdigit() or part.isalpha() and n == 1 or len(part) >= self.ratio * n


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, place of the kind, end)`` of the three patterns, in order."""
    found = []
    lower = text.lower()
    if any(x in lower for x in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, random: RandomStrings) -> list[tuple[int, int, int]]:
    found = base_spans(text)
    base, first = list(found), 0
    reach = list(accumulate((b for _, _, b in base), max))  # the furthest end so far
    for run in RUN.finditer(text):
        while first < len(base) and reach[first] <= run.start():
            first += 1
        if random.is_random(run[0]):
            found += rest_spans(text, run.start(), run.end(), base, first, random)
    return sorted(found)


def rest_spans(text: str, at: int, end: int, base: list[tuple[int, int, int]], first: int, random: RandomStrings) -> list[tuple[int, int, int]]:
    """A random run, or what spans of the patterns, of which those before ``first`` end before it, leave of it."""
    pieces, start = [], at
    for a, _, b in islice(base, first, None):
        if a >= end:
            break
        if b > at:
            pieces.append((at, a))
            at = b
    if not pieces:
        return [(start, 3, end)]
    found = []
    for a, b in [*pieces, (at, end)]:
        piece = text[a:b] if a < b else ""
        rest = piece.strip("_/=+-")
        if rest and not random.is_plain(rest):
            a += piece.index(rest)
            found.append((a, 3, a + len(rest)))
    return found


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by one mark."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPANS_TYPE = "array<struct<kind:string,start:bigint,stop:bigint>>"


def scan_secrets(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, spans`` and, with ``with_text``, ``redacted``: one row per document.

    ``spans`` are ordered by start, then kind; code points, end exclusive. ``vocabulary`` and ``pattern``: a
    tiktoken file and its splitting pattern. Null and empty texts have no spans (``redacted`` keeps the null). Repeated
    rows are scanned each for itself; an empty table gives no rows; other columns are not read. Narrow: no shuffle, one document in memory at a time.
    """
    rows = keyed_text(docs, id_col, text_col)
    key = (vocabulary, pattern, max_chars_per_token)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = kept(key, lambda: RandomStrings(*key))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [all_spans(x, random) if x else [] for x in texts]
            columns = [batch.column(0), pa.array([[(KINDS[k], a, b) for a, k, b in found] for found in spans], kind)]
            if with_text:
                columns.append(pa.array([redact(x, found) if found else x for x, found in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "redacted"][: len(columns)])

    return map_batches(rows, work, f"doc_id {id_type(rows)}, spans {SPANS_TYPE}" + ", redacted string" * with_text, key)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every secret in the text replaced by a mark. Columns stay as they are.

    Null and empty texts stay; repeated rows are redacted each for itself; an empty table gives no rows.
    """
    found = scan_secrets(rest_and_text(docs, text_col), vocabulary, pattern, id_col="rest", with_text=True)
    return with_new_text(found, docs, text_col, "doc_id", F.col("redacted"), F.size("spans") > 0, length_col)
