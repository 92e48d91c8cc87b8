"""Parity sketches of shingle sets.

A token toggles bits of a sketch, so tokens that two sets share cancel out: the bits in which two
sketches differ number at most the symmetric difference of the sets. Sketches come in two forms. The plain one,
one bit per token, bounds the difference of a given pair. The block form has as many blocks as a band of sizes may
differ in tokens, and more: two sets above the similarity then agree in a whole block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

SHINGLE_WORDS = 5
SHARE = (4, 5)  # two sets link when intersection >= 4/5 of the union
SHORT_BITS = 512
SPARE_MATCHES = 2  # whole blocks, not empty, in which a linked pair agrees at least

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(32))


def shingles(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; all words are one shingle where there are fewer than ``width``."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    rows = len(words) - width + 1
    found = np.zeros(rows, np.uint64)
    for at in range(width):
        found = mixed(found * _ODD + ids[at : at + rows])
    return np.unique(found)


def set_key(found: np.ndarray) -> int:
    """A 64-bit key of the set, as a signed number."""
    both = np.array([mixed(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(found), len(found)], np.uint64)
    return xxhash.xxh3_64_intdigest(both.tobytes()) - (1 << 63)


def sketch(found: np.ndarray) -> bytes:
    """One bit per token. The length is a power of two, about as many bits as tokens: see ``differing_bits``."""
    bits = max(SHORT_BITS, 1 << max(len(found) - 1, 0).bit_length())
    parity = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch of ``size`` 64-bit words from a longer one: its parts, one over the other."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))


def may_link(n: int, m: int, a: bytes, b: bytes) -> bool:
    """Exact bounds for two sets by their sizes and sketches; False only where they can't link."""
    part, whole = SHARE
    if min(n, m) * whole < max(n, m) * part:
        return False
    return differing_bits(a, b) <= most_apart(n, m)


def most_apart(smaller: int, larger: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    part, whole = SHARE
    return (smaller + larger) * (whole - part) // (whole + part)


def largest_partner(size: int) -> int:
    return size * SHARE[1] // SHARE[0]


@lru_cache(maxsize=None)
def bands(upto: int) -> tuple[int, ...]:
    """Lower ends of the bands of sizes, from the smallest size that can link with another set."""
    ends = [SHARE[0]]
    while ends[-1] <= upto:
        ends.append(max(ends[-1] + 1, ends[-1] * 7 // 4))
    return tuple(ends)


def block_keys(found: np.ndarray) -> np.ndarray:
    """Keys of the set's blocks that are not empty, as signed 64-bit numbers.

    Two linked sets that are not equal have ``SPARE_MATCHES`` keys in common. A set of size n stands in the
    band of its size, and in the band below when a set from there could link with it. In a band with sets below
    size U, linked sets differ in at most U/4 tokens, so in at most as many blocks. Only blocks with tokens count; a set
    that fills too few for the guarantee is cut into more blocks as well, until it fills enough. Either set's guarantee
    serves the pair, and sets without it stand side by side on the next level.
    """
    n = len(found)
    if n < SHARE[0]:
        return np.zeros(0, np.int64)
    ends = bands(largest_partner(n) + 2)
    home = int(np.searchsorted(ends, n, "right")) - 1
    out = []
    for band in (home, home - 1):
        if band < 0 or band < home and n > largest_partner(ends[band + 1] - 1):
            continue
        top = ends[band + 1] - 1
        apart = most_apart(n, largest_partner(n) if band == home else top)
        blocks = most_apart(top, largest_partner(top)) + SPARE_MATCHES + (1 if top < 32 else 2) + top // 96
        level = 0
        while True:
            seed = np.uint64(xxhash.xxh3_64_intdigest(b"%d/%d" % (band, level)))
            spots = mixed(found ^ seed)
            block = (spots % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            filled, firsts = np.unique(block[order], return_index=True)
            values = np.bitwise_xor.reduceat(mixed(found + seed)[order], firsts)
            out.append(mixed(values ^ mixed(filled.astype(np.uint64) + seed)).view(np.int64))
            if len(filled) >= apart + SPARE_MATCHES:
                break
            level, blocks = level + 1, blocks * 4
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SHARE[1] >= (len(a) + len(b) - both) * SHARE[0] if both else False
