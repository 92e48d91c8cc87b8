"""Phrases whose words stand together more often than chance has it, mined with stripes.

A stripe is the counter of what follows one prefix: next word to number of times. Tasks count stripes over the
texts; Spark merges those of one prefix elementwise. Prefixes grow by a word from pass to pass, and a pass looks
only at phrases both ends of which are frequent already. The merged stripes then hold everything: extensions are
their entries, the total of a prefix is its own entry in the stripe of the prefix a word shorter, that of the
empty prefix the sum of its stripe (rare words count there under the empty word), and the largest extension of a
phrase, to the right or left, is a maximum over entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches, pick
from wordloom.llm.tokenizing import text_blocks
from wordloom.session import stage

MIN_COUNT, MAX_WORDS, KEPT = 100, 5, 2000
FILTER_BITS = 1 << 24  # of the filter of frequent phrases: 2 MB whatever the corpus
PARTS = (1024, 32, 8)  # a stripe is dealt out by the hash of the next word: prefixes of no word, of one, of more
BUCKETS = 1024  # stripes of a language travel in so many rows from each task
SLICE_BYTES = 4 << 20  # of a text, cut into words at a time
KNOWN_WORDS = 1 << 19  # per task; beyond, what was counted is sent on and the words are forgotten
PENDING = 1 << 22  # counted phrases of a task that wait to be merged
TASKS_PER_CORE = 2  # each sends what it has found; so that grows with the frequent phrases, not also with the tasks
_PACKED = 3  # ids of 21 bits in one integer
_CELL_BITS = 46
_PART_STEP = 7919
_SEED = 42  # of Spark's xxhash64
_TURN = 13

#: Lower-cases A-Z; breaks between pieces become full stops, tabs spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_BREAK = b"."


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _SEED)


def _phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes of the words, in order."""
    total = words[0].copy()
    for i, each in enumerate(words[1:], 1):
        turn = np.uint64(_TURN * i % 64)
        total ^= (each << turn) | (each >> (np.uint64(64) - turn))
    return total


def _phrase_hash_column(phrase: str, n_words: int) -> Column:
    """The same hash as a Spark expression."""
    words = F.split(phrase, " ")
    total = F.xxhash64(F.get(words, F.lit(0)))
    for i in range(1, n_words):
        each, turn = F.xxhash64(F.get(words, F.lit(i))), _TURN * i % 64
        total = total.bitwiseXOR(F.shiftleft(each, turn).bitwiseOR(F.shiftrightunsigned(each, 64 - turn)))
    return total


def _bitmap(rows: DataFrame, at: Column, bits: int) -> bytes:
    """A bitmap of ``bits`` bits, set at the lowest bits of ``at``.

    Executors merge pieces of 4 kB; the driver gets at most ``bits / 8`` bytes, however many rows there are.
    """
    place = at.bitwiseAND(F.lit(bits - 1)) + 1
    pieces = rows.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
    out = bytearray(max(bits // 8, 4096))
    for piece, found in pieces.collect():
        out[(piece - 1) * 4096 : piece * 4096] = found
    return bytes(out)


def phrase_filter(phrases: DataFrame, n_words: int, bits: int = FILTER_BITS) -> bytes:
    """A bitmap for the ``lang, phrase`` rows; all phrases have ``n_words`` words."""
    return _bitmap(phrases, F.xxhash64("lang").bitwiseXOR(_phrase_hash_column("phrase", n_words)), bits)


def pair_filter(docs: DataFrame, allowed: bytes, min_count: int, bits: int = FILTER_BITS) -> bytes:
    """A bitmap that holds all pairs of allowed words that occur ``min_count`` times, and some more.

    Pairs are counted by hashes of 46 bits, which take a tenth of the room of their words; pairs of one hash are added up.
    """
    sent = docs.sparkSession.sparkContext.broadcast(allowed)
    local = map_batches(docs, lambda batches: count_pairs(batches, sent.value), "bucket int, lows array<int>, counts array<int>")
    dealt = local.repartition("bucket").select("bucket", F.explode(F.arrays_zip("lows", "counts")).alias("cell"))
    cells = dealt.groupBy("bucket", F.col("cell.lows").alias("low")).agg(F.sum(F.col("cell.counts").cast("long")).alias("n"))
    return _bitmap(cells.where(F.col("n") >= min_count), F.col("low").cast("long"), bits)


class Words(dict):
    """Local numbers of the words of a language: 0 for breaks and for words that the filter does not hold."""

    def __init__(self, lang: str, allowed: np.ndarray | None) -> None:
        self.lang_hash, self.allowed = _hash(lang.encode()), allowed
        self.spelled, self.hashes = [b""], [0]
        self.keys: list[list[np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        self.tail = np.zeros(0, np.int64)
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        found = _hash(word)
        if self.allowed is not None and not self.allowed[(found ^ self.lang_hash) & (len(self.allowed) - 1)]:
            self[word] = 0
            return 0
        self[word] = number = len(self.spelled)
        self.spelled.append(word)
        self.hashes.append(found)
        return number

    def forget(self) -> None:
        """Forget the words that the filter does not hold; the others keep their numbers."""
        kept = {word: number for word, number in self.items() if number}
        self.clear()
        self.update(kept)
        self[_BREAK] = 0

    def passes(self, bitmap: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """Whether the filter holds the phrases of these word hashes."""
        return bitmap[(self.phrases(words) & np.uint64(len(bitmap) - 1)).astype(np.int64)]

    def phrases(self, words: list[np.ndarray]) -> np.ndarray:
        return _phrase_hash(words) ^ np.uint64(self.lang_hash)

    def add(self, keys: list[np.ndarray], counts: np.ndarray) -> None:
        if len(counts):
            self.keys.append(keys)
            self.counts.append(counts)
        if sum(map(len, self.counts)) > PENDING and len(self.counts) > 1:
            self.merge()

    def merge(self) -> None:
        keys = [np.concatenate(x) for x in zip(*self.keys, strict=True)]
        merged, counts = counted(keys, np.concatenate(self.counts))
        self.keys, self.counts = [merged], [counts]


def counted(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (of one or more columns) in order, with the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return [k[starts] for k in keys], np.add.reduceat(counts[order], starts)


def _pack(columns: list[np.ndarray]) -> list[np.ndarray]:
    packed = []
    for at in range(0, len(columns), _PACKED):
        total = columns[at].astype(np.int64)
        for each in columns[at + 1 : at + _PACKED]:
            total = (total << 21) | each
        packed.append(total)
    return packed


def _unpack(packed: list[np.ndarray], n: int) -> list[np.ndarray]:
    columns: list[np.ndarray] = []
    for total in packed:
        here = min(_PACKED, n - len(columns))
        columns += [(total >> (21 * (here - 1 - i))) & ((1 << 21) - 1) for i in range(here)]
    return columns


def slices(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in parts that end at a space or at the end of the text."""
    start = 0
    while len(text) - start > most:
        at = text.rfind(b" ", start, start + most)
        if at < 0 and (at := text.find(b" ", start + most)) < 0:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def _prefixes(words: Words, tokens: list[bytes], level: int) -> list[np.ndarray]:
    """Columns of ids: each prefix of ``level - 1`` words and what follows; the last words are kept for the next slice."""
    new = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    if level == 1:
        return [new]
    ids = np.concatenate([words.tail, new])
    words.tail = ids[len(ids) - min(level - 1, len(ids)) :]
    n = max(0, len(ids) - level + 1)
    columns = [ids[i : i + n] for i in range(level)]
    whole = columns[0] > 0
    for each in columns[1:-1]:
        whole &= each > 0
    at = np.flatnonzero(whole)
    return [c[at] for c in columns]


def _count_slice(words: Words, tokens: list[bytes], level: int, ends: np.ndarray | None, pairs: np.ndarray | None, rests: bool) -> None:
    """Count what follows each prefix of ``level - 1`` words that ``ends`` holds."""
    columns = _prefixes(words, tokens, level)
    if level == 1:
        found = np.bincount(columns[0])
        found[:1] = 0
        at = np.flatnonzero(found)
        words.add([at], found[at])
        return
    hashes = np.array(words.hashes, np.uint64)
    spelled = [hashes[c] for c in columns]
    if ends is not None:
        held = words.passes(ends, spelled[:-1])
        columns, spelled = [c[held] for c in columns], [s[held] for s in spelled]
        columns[-1] = np.where((columns[-1] > 0) & words.passes(ends, spelled[1:]), columns[-1], 0)
    if pairs is not None:
        columns[-1] = np.where((columns[-1] > 0) & words.passes(pairs, spelled), columns[-1], 0)
    if not rests:
        followed = columns[-1] > 0
        columns = [c[followed] for c in columns]
    if len(columns[0]):
        words.add(*counted(_pack(columns), np.ones(len(columns[0]), np.int64)))


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before, and the number of rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def _stripe_rows(lang: str, words: Words, level: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """What was counted as rows ``lang, bucket, stripes``."""
    if not words.counts:
        return
    words.merge()
    columns, counts = _unpack(words.keys[0], level), words.counts[0]
    spelled, hashes = pa.array(words.spelled, pa.binary()).cast(pa.string()), np.array(words.hashes, np.uint64)
    part = (hashes % np.uint64(PARTS[min(level, len(PARTS)) - 1]))[columns[-1]]
    prefix_hash = _phrase_hash([hashes[c] for c in columns[:-1]]) if level > 1 else np.uint64(0)
    bucket = ((prefix_hash + part * np.uint64(_PART_STEP)) % np.uint64(BUCKETS)).astype(np.int32)
    order = np.lexsort([part, *columns[-2::-1], bucket])
    columns, counts, part, bucket = [c[order] for c in columns], counts[order], part[order], bucket[order]
    starts = _changes([bucket, part, *columns[:-1]])  # of stripes, by entries
    heads = starts[:-1]
    edges = _changes([bucket[heads]])  # of buckets, by stripes
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(starts[edges], starts[edges[first]] + most, "right")) - 1)
        stripes = heads[edges[first] : edges[last]]
        here = slice(starts[edges[first]], starts[edges[last]])
        prefix = pa.array([""] * len(stripes), pa.string())
        if level > 1:
            prefix = pc.binary_join_element_wise(*(spelled.take(pa.array(c[stripes])) for c in columns[:-1]), " ")
        offsets = pa.array((starts[edges[first] : edges[last] + 1] - here.start).astype(np.int32))
        maps = pa.MapArray.from_arrays(offsets, spelled.take(pa.array(columns[-1][here])), pa.array(counts[here]))
        held = pa.StructArray.from_arrays([prefix, maps], ["prefix", "stripe"])
        lists = pa.ListArray.from_arrays(pa.array((edges[first : last + 1] - edges[first]).astype(np.int32)), held)
        buckets = pa.array(bucket[heads[edges[first:last]]])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (last - first), pa.string()), buckets, lists], names=["lang", "bucket", "stripes"])
        first = last


def _map(bitmap: bytes | None) -> np.ndarray | None:
    return None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)


def _spoken(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[str, list[bytes], bool]]:
    """``lang, words, whether they go on from the last ones`` of batches of ``lang, text`` without nulls."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for block in text_blocks(texts):
            for lang, group in groupby(sorted(block, key=langs.__getitem__), langs.__getitem__):
                joined = b" . ".join(texts[i] for i in group).translate(_PLAIN).replace(_BREAK, b" . ")
                for i, part in enumerate(slices(joined + b" .", slice_bytes)):
                    yield lang, part.split(), i > 0


def count_stripes(
    batches: Iterator[pa.RecordBatch],
    level: int,
    allowed: bytes | None = None,
    ends: bytes | None = None,
    pairs: bytes | None = None,
    slice_bytes: int = SLICE_BYTES,
    known_words: int = KNOWN_WORDS,
    rests: bool = True,
) -> Iterator[pa.RecordBatch]:
    """Stripes of batches of ``lang, text`` without nulls; memory is bounded by the two limits.

    With ``rests``, what follows a prefix at a break or is too rare counts under the empty word, so that each stripe adds
    up to all occurrences of its prefix; without, such words are left out, except after the empty prefix.
    """
    allowed, ends, pairs = _map(allowed), _map(ends), _map(pairs)
    tables: dict[str, Words] = {}
    for lang, tokens, more in _spoken(batches, slice_bytes):
        words = tables.get(lang) or tables.setdefault(lang, Words(lang, allowed))
        if not more:
            words.tail = np.zeros(level - 1, np.int64)
        _count_slice(words, tokens, level, ends, pairs, rests)
        full = sum(map(len, tables.values())) > known_words
        if full and allowed is not None:  # mostly of rare words, which hold no counts
            for each in tables.values():
                each.forget()
            full = sum(map(len, tables.values())) > known_words // 2
        if full or (words.counts and len(words.counts[0]) > PENDING):
            tail = [words.spelled[i] for i in words.tail.tolist()]
            for name in list(tables):
                yield from _stripe_rows(name, tables.pop(name), level)
            words = tables.setdefault(lang, Words(lang, allowed))
            words.tail = np.array([words[w] if w else 0 for w in tail], np.int64)
    for name, words in tables.items():
        yield from _stripe_rows(name, words, level)


def count_pairs(batches: Iterator[pa.RecordBatch], allowed: bytes, slice_bytes: int = SLICE_BYTES, known_words: int = KNOWN_WORDS) -> Iterator[pa.RecordBatch]:
    """``bucket, lows, counts``: how often pairs of allowed words occur, by their hashes."""
    allowed, tables, found = _map(allowed), {}, Words("", None)

    def rows() -> Iterator[pa.RecordBatch]:
        if not found.counts:
            return
        found.merge()
        (cells,), counts = found.keys[0], found.counts[0]
        bucket = cells >> 32
        starts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(cells)).astype(np.int32)
        lows = (cells & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        columns = [pa.array(bucket[starts[:-1]].astype(np.int32))]
        columns += [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (lows, np.minimum(counts, 2**31 - 1).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lows", "counts"])
        found.keys, found.counts = [], []

    for lang, tokens, more in _spoken(batches, slice_bytes):
        words = tables.get(lang) or tables.setdefault(lang, Words(lang, allowed))
        if not more:
            words.tail = np.zeros(1, np.int64)
        first, second = _prefixes(words, tokens, 2)
        hashes, both = np.array(words.hashes, np.uint64), second > 0
        if both.any():
            cells = words.phrases([hashes[first[both]], hashes[second[both]]]) & np.uint64((1 << _CELL_BITS) - 1)
            found.add(*counted([cells.astype(np.int64)], np.ones(len(cells), np.int64)))
        if sum(map(len, tables.values())) > known_words:
            last = words.spelled[int(words.tail[-1])]
            tables = {lang: (words := Words(lang, allowed))}
            words.tail = np.array([words[last] if last else 0], np.int64)
        if found.counts and len(found.counts[0]) > PENDING:
            yield from rows()
    yield from rows()


def gathered(rows: DataFrame) -> DataFrame:
    """The rows in so many partitions as the cluster works on, without a shuffle.

    Nearly every task meets every frequent phrase. With a task per piece of the input, stripes would grow with the
    frequent phrases and with the tasks, that is with the square of the input.
    """
    return rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def local_stripes(docs: DataFrame, level: int, allowed: bytes | None = None, ends: bytes | None = None, pairs: bytes | None = None, rests: bool = True) -> DataFrame:
    """``lang, bucket, stripes``: what follows the prefixes of ``level - 1`` words, as each task counts it."""
    sent = docs.sparkSession.sparkContext.broadcast((allowed, ends, pairs))  # bitmaps of FILTER_BITS
    return map_batches(docs, lambda batches: count_stripes(batches, level, *sent.value, rests=rests), "lang string, bucket int, stripes array<struct<prefix:string,stripe:map<string,bigint>>>")


def merged_stripes(local: DataFrame, min_count: int, level: int) -> DataFrame:
    """``lang, prefix, next, n``: the stripes of all tasks added elementwise, without rare next words.

    In the stripe of the empty prefix (level 1) those go to the empty word instead, so that it adds up to all words.
    Stripes are dealt out by buckets of prefix and part, so that a long one spreads; adding up needs no other shuffle.
    """
    held = local.repartition("lang", "bucket").select("lang", "bucket", F.explode("stripes").alias("held"))
    entries = held.select("lang", "bucket", F.col("held.prefix").alias("prefix"), F.explode("held.stripe").alias("next", "n"))
    added = entries.groupBy("lang", "bucket", "prefix", "next").agg(F.sum("n").alias("n"))
    if level > 1:
        return added.where(F.col("n") >= min_count).drop("bucket")
    folded = F.when(F.col("n") >= min_count, F.col("next")).otherwise("")
    return added.groupBy("lang", "prefix", folded.alias("next")).agg(F.sum("n").alias("n"))


def stripes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """The merged stripes, staged, of prefixes of 0 to ``max_words - 1`` words; ends early when no phrase is frequent."""
    rows = pick(docs, lang=lang_col, text=text_col)
    rows = rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = gathered(rows)
    levels: list[DataFrame] = []
    allowed = ends = pairs = None
    for level in range(1, max_words + 1):
        levels.append(stage(merged_stripes(local_stripes(rows, level, allowed, ends, pairs, rests=False), min_count, level), f"stripes-{level}"))
        frequent = phrases_of(levels[-1])
        if level == max_words or frequent.isEmpty():
            break
        ends, pairs = phrase_filter(frequent, level, filter_bits), None
        if level == 1:  # of all levels the one with most different phrases
            allowed, ends = ends, None
            pairs = pair_filter(rows, allowed, min_count, filter_bits)
    return levels


def phrases_of(level: DataFrame) -> DataFrame:
    """``lang, prefix, phrase, n`` of the entries of stripes, without the empty word."""
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return level.where("next <> ''").select("lang", "prefix", phrase.alias("phrase"), "n")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for each in frames[1:]:
        out = out.unionByName(each)
    return out


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    kept: int = KEPT,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The best ``kept`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at spaces and
    tabs. ``n`` is all words of a language. A phrase has 2 to ``max_words`` words and occurs ``a >= min_count`` times. Of
    its cuts into two parts with ``l`` and ``r`` occurrences the one with the lowest ``floor(1000 a n / (l r))`` is its
    score; ties go to the shorter first part. A phrase inside a longer one that occurs as often is left out. Order: score,
    ``a``, both descending, then the phrase by its bytes, so there are no ties.

    A null language counts as ``und``; null and empty texts have no words; repeated rows count each; an empty table gives
    no rows; other columns are not read, whatever their names. A long text is cut into words slice by slice, and phrases go
    on from slice to slice. Every pass reads all texts; a filter of fixed size (``filter_bits``) keeps phrases with rare
    parts from being counted, and what it lets through by chance is dropped by its count. Needs ``max_words >= 2``.
    """
    if max_words < 2 or min_count < 1 or filter_bits < 1 << 15 or filter_bits & (filter_bits - 1):
        raise ValueError("max_words must be 2 or more, min_count 1 or more, filter_bits a power of two from 32768")
    levels = stripes(docs, lang_col, text_col, min_count, max_words, filter_bits)
    sizes = [phrases_of(each).withColumn("size", F.lit(i)) for i, each in enumerate(levels, 1)]
    if len(sizes) == 1:
        sizes.append(sizes[0].where("false"))
    found = _union(sizes[1:])
    # A phrase inside a longer one that is as frequent is inside one that is longer by one word, too.
    longer = found.where("size > 2")
    wider = longer.select("lang", F.col("prefix").alias("phrase"), "n").unionByName(
        longer.select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "n")
    )
    most = wider.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    alone = found.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("n")))
    cuts = alone.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("rest"))
    totals = _union(sizes)  # both parts of a frequent phrase are frequent, hence entries of stripes themselves
    left = totals.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = totals.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    words = levels[0].groupBy("lang").agg(F.sum("n").alias("n"))
    known = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(words, "lang")
    wide = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    lowest = known.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
