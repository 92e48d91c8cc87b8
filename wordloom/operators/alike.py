"""Which entries near each other are alike: blocks of ordered entries compared as arrays, in the workers.

An entry has a text and a list of further texts. Two are alike if their own texts, or any two of the further ones,
are within an edit distance, counted in code points. Texts that a task meets first get a slot in a table that keeps what was
found of two of them, so pairs of frequent texts are looked up. Other pairs are compared by length, by a sketch of their
letters, and then by a bit-parallel edit distance (Myers; Hyyrö's form) over many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts with a slot: their table of pairs takes the square of it in bytes.
SLOTS = 4096
# Entries that are noted as met once.
MET = 1 << 16
# Pairs whose edit distances are taken at once, and the longest pattern of one machine word.
PAIRS_AT_ONCE = 1 << 14
WORD_BITS = 64
# Places of a block: its entries times the neighbours of each.
PLACES_AT_ONCE = 1 << 19
# Rows and bytes that are gathered before they are compared, and alike entries of a batch of rows.
BLOCK_ROWS = 1 << 15
BLOCK_BYTES = 1 << 24
FOUND_AT_ONCE = 1 << 18
# Code points that are looked at together.
SIGNS_AT_ONCE = 1 << 20
# Pairs of further texts that are laid out at once.
TEXT_PAIRS_AT_ONCE = 1 << 20

_UNKNOWN, _APART, _NEAR = 0, 1, 2


class Texts:
    """Distinct texts: their code points, lengths and sketches."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int32)
        self.bits = np.zeros(len(self.lengths), np.uint64)
        # Short texts side by side, filled up with a number that is no code point.
        wide = int(min(WORD_BITS, max(1, self.lengths.max(initial=0))))
        self.matrix = np.full((len(self.lengths), wide), np.iinfo(np.uint32).max, np.uint32)
        run = np.cumsum(self.lengths, dtype=np.int64) // SIGNS_AT_ONCE
        for some in np.split(np.arange(len(self.lengths)), np.flatnonzero(np.diff(run)) + 1):
            points, size = _points(texts.take(pa.array(some))), self.lengths[some]
            starts = np.cumsum(size) - size
            filled = np.flatnonzero(size)
            if filled.size:
                letters = np.uint64(1) << (points & np.uint32(63)).astype(np.uint64)
                self.bits[some[filled]] = np.bitwise_xor.reduceat(letters, starts[filled])
            short = np.flatnonzero(size <= wide)
            rows, within = np.repeat(short, size[short]), _ramps(size[short])
            self.matrix[some[rows], within] = points[starts[rows] + within]
        if self.matrix.size and np.where(self.matrix == np.iinfo(np.uint32).max, 0, self.matrix).max() < 255:
            self.matrix = self.matrix.astype(np.uint8)

    def near(self, left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
        """Whether the texts of each pair, given by their places, are within the distance."""
        a, b = self.lengths[left], self.lengths[right]
        out = left == right
        # An edit turns over two bits of the sketch at most, and changes the length by one at most.
        maybe = ~out & (np.abs(a - b) <= distance)
        maybe &= np.bitwise_count(self.bits[left] ^ self.bits[right]) <= 2 * distance
        # The larger length bounds the distance.
        small = maybe & (np.maximum(a, b) <= distance)
        out |= small
        rest = np.flatnonzero(maybe & ~small)
        if rest.size:
            swap = a[rest] > b[rest]
            a, b = left[rest], right[rest]
            out[rest] = self._edits(np.where(swap, b, a), np.where(swap, a, b), distance)
        return out

    def _edits(self, short: np.ndarray, long: np.ndarray, distance: int) -> np.ndarray:
        out = np.zeros(len(short), bool)
        sizes = self.lengths[long]
        # Texts beyond a machine word are rarely of nearly the same length and letters.
        for at in np.flatnonzero(sizes > WORD_BITS):
            one, other = (_points(self.texts.slice(int(x), 1)) for x in (short[at], long[at]))
            out[at] = _within(one, other, distance)
        low = 0
        for bits, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)):
            at = np.flatnonzero((sizes > low) & (sizes <= bits))
            low = bits
            for begin in range(0, len(at), PAIRS_AT_ONCE):
                some = at[begin : begin + PAIRS_AT_ONCE]
                # The longest first, so that those not at their end are in front.
                some = some[np.argsort(-sizes[some].astype(np.int8), kind="stable")]
                out[some] = _distances(self, short[some], long[some], kind, distance) <= distance
        return out


def _points(texts: pa.Array) -> np.ndarray:
    """The code points of texts, one after the other."""
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)


def _ramps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if ends.size else 0) - np.repeat(ends - sizes, sizes)


class Memory:
    """What was found of pairs of entries, for ``SLOTS`` entries with one further text that were met in two blocks."""

    def __init__(self, slots: int = SLOTS):
        self.size = slots + 1
        # Slot 0 stands for all without one: nothing is ever known of it.
        self.slot_of: dict[tuple[str, str], int] = {}
        self.known = np.zeros(self.size * self.size, np.uint8)
        self.met: set[int] = set()

    def slots(self, keys: Iterator[tuple[str, str]]) -> np.ndarray:
        out = []
        for key in keys:
            slot = self.slot_of.get(key, 0)
            if not slot and len(self.slot_of) < self.size - 1:
                seen = hash(key)
                # Long texts rarely come again, and would be kept.
                if seen in self.met and len(key[0]) + len(key[1]) <= WORD_BITS:
                    slot = self.slot_of[key] = len(self.slot_of) + 1
                elif len(self.met) < MET:
                    self.met.add(seen)
            out.append(slot)
        return np.array(out, np.int32)

    def learn(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        both = np.flatnonzero((left > 0) & (right > 0))
        left, right = left[both], right[both]
        told = np.where(near[both], np.uint8(_NEAR), np.uint8(_APART))
        self.known[left * self.size + right] = told
        self.known[right * self.size + left] = told


def _distances(texts: Texts, short: np.ndarray, long: np.ndarray, kind: type, distance: int) -> np.ndarray:
    """Edit distances of pairs of texts that fit the bits of ``kind``, the second not shorter; longest second ones first.

    Right up to ``distance``, and beyond it there: letters further apart than that are not looked at.
    """
    sizes, ends = texts.lengths[short], texts.lengths[long]
    pattern = np.ascontiguousarray(texts.matrix[short, : int(sizes.max())].T)
    text = np.ascontiguousarray(texts.matrix[long, : int(ends[0])].T)
    score = sizes.astype(np.int16)
    last = np.where(sizes > 0, np.uint64(1) << np.maximum(sizes - 1, 0).astype(np.uint64), np.uint64(0)).astype(kind)
    one = kind(1)
    up, down = np.full(len(short), ~kind(0), kind), np.zeros(len(short), kind)
    for at in range(int(ends[0])):
        n = int(np.searchsorted(-ends, -at, "left"))
        # Those whose second text goes on; the others keep their score.
        letter, equal = text[at, :n], np.zeros(n, kind)
        for bit in range(max(0, at - distance), min(len(pattern), at + distance + 1)):
            equal |= (pattern[bit, :n] == letter).astype(kind) << kind(bit)
        pv, mv = up[:n], down[:n]
        xv = equal | mv
        xh = (((equal & pv) + pv) ^ pv) | equal
        ph = mv | ~(xh | pv)
        mh = pv & xh
        end = last[:n]
        score[:n] += ((ph & end) != 0).view(np.int8)
        score[:n] -= ((mh & end) != 0).view(np.int8)
        ph = (ph << one) | one
        mh = mh << one
        up[:n] = mh | ~(xv | ph)
        down[:n] = ph & xv
    # An empty text is as far as the other is long.
    return np.where(sizes > 0, score, ends)


def _within(a: np.ndarray, b: np.ndarray, distance: int) -> bool:
    """Whether the edit distance is at most ``distance``: furthest places along the diagonals, edit by edit."""

    def slid(x: int, y: int) -> int:
        step = 64
        while x < len(a) and y < len(b):
            m = min(step, len(a) - x, len(b) - y)
            other = np.flatnonzero(a[x : x + m] != b[y : y + m])
            if other.size:
                return x + int(other[0])
            x, y, step = x + m, y + m, step * 4
        return x

    goal = len(a) - len(b)
    reach = {0: slid(0, 0)}
    for edit in range(distance + 1):
        if reach.get(goal, -1) >= len(a):
            return True
        if edit == distance:
            break
        further: dict[int, int] = {}
        for k in range(-edit - 1, edit + 2):
            # x - y = k: one more of a alone, of both, or of b alone.
            steps = [reach[k - 1] + 1] if k - 1 in reach else []
            steps += [reach[k] + 1] if k in reach else []
            steps += [reach[k + 1]] if k + 1 in reach else []
            x = min(max(steps, default=-1), len(a), len(b) + k)
            if x >= max(0, k):
                further[k] = slid(x, x - k)
        reach = further
    return False


class Entries:
    """A block of entries: the codes of their own texts (-1: none), and of their further texts as runs."""

    def __init__(self, words: pa.Array, meanings: pa.ListArray, distance: int, memory: Memory):
        self.distance, self.memory = distance, memory
        coded, listed = pc.dictionary_encode(words), pc.dictionary_encode(meanings.flatten())
        self.words, self.texts = Texts(coded.dictionary), Texts(listed.dictionary)
        self.code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)
        self.listed = listed.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.sizes = pc.fill_null(pc.list_value_length(meanings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # Entries with one further text, as most have: no list has to be gone through, and pairs are remembered.
        lone = np.flatnonzero((self.sizes == 1) & (self.code >= 0))
        kinds, which = np.unique(self.code[lone].astype(np.int64) << 32 | self.listed[self.starts[lone]], return_inverse=True)
        own, further = coded.dictionary.take(pa.array(kinds >> 32)), listed.dictionary.take(pa.array(kinds & 0xFFFFFFFF))
        self.slot = np.zeros(len(self.code), np.int32)
        self.slot[lone] = memory.slots(zip(own.to_pylist(), further.to_pylist(), strict=True))[which]
        self.line = self.slot * np.int32(memory.size)
        # What rules most pairs out, in the order of the entries.
        self.plain = np.zeros(len(self.code), bool)
        self.plain[lone] = True
        self.hints = []
        for texts, held in ((self.words, self.code[lone]), (self.texts, self.listed[self.starts[lone]])):
            length, bits = np.zeros(len(self.code), np.int32), np.zeros(len(self.code), np.uint64)
            length[lone], bits[lone] = texts.lengths[held], texts.bits[held]
            self.hints.append((length, bits))

    def beside(self, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry from ``low`` and the one ``step`` behind it: whether they are known to be alike, and whether they may be."""
        here, there = slice(low, high - step), slice(low + step, high)
        known = self.memory.known.take(self.line[here] + self.slot[there])
        maybe = ~(self.plain[here] & self.plain[there])
        for length, bits in self.hints:
            like = np.bitwise_count(bits[here] ^ bits[there]) <= 2 * self.distance
            like &= np.abs(length[here] - length[there]) <= self.distance
            maybe |= like
        return known == _NEAR, maybe & (known == _UNKNOWN)

    def alike(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the entries of each pair, given by their places in the block, are alike."""
        a, b = self.code[left], self.code[right]
        told = np.flatnonzero((a >= 0) & (b >= 0))
        out = np.zeros(len(left), bool)
        out[told] = self.words.near(a[told], b[told], self.distance)
        rest = np.flatnonzero(~out)
        a, b = left[rest], right[rest]
        n, m = self.sizes[a], self.sizes[b]
        lone = (n == 1) & (m == 1)
        out[rest[lone]] = self.texts.near(self.listed[self.starts[a[lone]]], self.listed[self.starts[b[lone]]], self.distance)
        many = ~lone & (n > 0) & (m > 0)
        out[rest[many]] = self._meet(a[many], b[many])
        self.memory.learn(self.slot[left], self.slot[right], out)
        return out

    def _meet(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), bool)
        pairs = self.sizes[left] * self.sizes[right]
        run = np.cumsum(pairs) // TEXT_PAIRS_AT_ONCE
        for some in np.split(np.arange(len(left)), np.flatnonzero(np.diff(run)) + 1):
            if len(some) == 1 and pairs[some[0]] > TEXT_PAIRS_AT_ONCE:
                out[some] = self._long_lists(int(left[some[0]]), int(right[some[0]]))
            elif len(some):
                its, n = np.repeat(some, pairs[some]), self.sizes[right]
                within = _ramps(pairs[some])
                a = self.listed[self.starts[left[its]] + within // n[its]]
                b = self.listed[self.starts[right[its]] + within % n[its]]
                out[its[self.texts.near(a, b, self.distance)]] = True
        return out

    def _long_lists(self, left: int, right: int) -> bool:
        others = self.listed[self.starts[right] : self.starts[right] + self.sizes[right]]
        mine = self.listed[self.starts[left] : self.starts[left] + self.sizes[left]]
        return any(self.texts.near(np.full_like(others, one), others, self.distance).any() for one in mine)


def found_beside(entries: Entries, at: np.ndarray, reach: np.ndarray, asking: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of asking entries, in their order: which, how many alike entries each finds, and where those stand.

    ``reach`` is how many of the entries behind an entry of the block it can see, ``at`` its place: those of the same place
    do not see each other. What one sees the other sees, so each pair is compared once, by its earlier entry.
    """
    tied = bool((at[1:] == at[:-1]).any())
    total, far = len(reach), int(reach.max(initial=0))
    rows = max(far, PLACES_AT_ONCE // max(2 * far, 1), 1)
    for begin in range(0, total, rows):
        end = min(total, begin + rows)
        low, high = max(0, begin - far), min(total, end + far)
        size = high - low
        # A line per step back or ahead, the furthest back first.
        seen = np.zeros((2 * far, size), bool)
        wanted = asking[low:high] & (np.arange(low, high) >= begin) & (np.arange(low, high) < end)
        lefts, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, min(far, size - 1) + 1):
            meets = (reach[low : high - step] >= step) & (wanted[:-step] | wanted[step:])
            if tied:
                meets &= at[low : high - step] != at[low + step : high]
            near, maybe = entries.beside(low, high, step)
            near &= meets
            seen[far + step - 1, :-step] = near
            seen[far - step, step:] = near
            places = np.flatnonzero(meets & maybe)
            lefts.append(places)
            steps.append(np.full(len(places), step))
        left, step = np.concatenate(lefts), np.concatenate(steps)
        hit = entries.alike(left + low, left + step + low)
        left, step = left[hit], step[hit]
        seen[far + step - 1, left] = True
        seen[far - step, left + step] = True
        its = np.flatnonzero(wanted)
        table = np.ascontiguousarray(seen.T[its])
        counts = np.count_nonzero(table, axis=1) if far else np.zeros(len(its), np.int64)
        flat = np.flatnonzero(table)
        at, column = (flat // (2 * far), flat % (2 * far)) if far else (flat, flat)
        others = its[at] + np.where(column < far, column - far, column - far + 1) if far else flat
        yield its + low, counts, others + low


def _line_starts(block: pa.Table) -> np.ndarray:
    """Places of a block at which another sequence or cell begins."""
    other = np.zeros(block.num_rows, bool)
    for name in ("sequence", "cell"):
        codes = pc.fill_null(pc.dictionary_encode(block[name].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        other[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(other)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches``, ordered by sequence and cell, in blocks that cut no cell."""
    held: pa.Table | None = None
    due = 0
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < max(due, BLOCK_ROWS) and held.nbytes < BLOCK_BYTES:
            continue
        starts = _line_starts(held)
        if starts.size:
            yield held.slice(0, int(starts[-1])).combine_chunks()
            held, due = held.slice(int(starts[-1])).combine_chunks(), 0
        else:
            due = 2 * held.num_rows
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def similar_rows(batches: Iterator[pa.RecordBatch], distance: int, neighbours: int, give: str | None) -> Iterator[pa.RecordBatch]:
    """``row`` of the asking rows of cells, and ``found``, a list of its field ``give`` in those they are alike to.

    Without ``give`` the list says how many places each is away.

    Columns: ``sequence, cell, at, asks, spelled, meanings, row``; rows ordered by the first three.
    """
    memory = Memory()
    for block in whole_cells(batches):
        cuts = np.zeros(block.num_rows, bool)
        cuts[_line_starts(block)] = True
        line = np.cumsum(cuts)
        at = pc.fill_null(block["at"], 0).to_numpy()
        # Places within their cell, a cell behind the other, so far apart that none reaches the next.
        first = at[np.searchsorted(line, line)]
        place = at - first
        apart = int(place.max(initial=0)) + neighbours + 1
        key = place + line * apart
        reach = np.searchsorted(key, key + neighbours, "right") - np.arange(len(key)) - 1
        column = {name: _whole(block[name]) for name in ("asks", "spelled", "meanings", "row")}
        entries = Entries(column["spelled"], column["meanings"], distance, memory)
        asking = column["asks"].to_numpy(zero_copy_only=False)
        for its, counts, others in found_beside(entries, key, reach, asking):
            for low, high in _runs(counts):
                begin, end = counts[:low].sum(), counts[:high].sum()
                ends = np.concatenate([[0], np.cumsum(counts[low:high])])
                its_own = others[begin:end]
                if give is None:
                    given = pa.array(key[its_own] - np.repeat(key[its[low:high]], counts[low:high]), pa.int32())
                else:
                    given = column["row"].field(give).take(pa.array(its_own))
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), given)
                yield pa.RecordBatch.from_arrays([_picked(column["row"], its[low:high]), found], names=["row", "found"])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _picked(column: pa.Array, rows: np.ndarray) -> pa.Array:
    """The rows of a column, which stand in their order; most stand side by side."""
    if rows[-1] - rows[0] == len(rows) - 1:
        return column.slice(int(rows[0]), len(rows))
    return column.take(pa.array(rows))


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with a bounded number of found ones."""
    run = np.cumsum(counts) // FOUND_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(counts)]
    return ((low, high) for low, high in zip(cuts[:-1], cuts[1:], strict=True) if low < high)
