"""Words and word shingles of whole batches of texts as 64-bit hashes.

A batch's bytes are hashed as one stream: every byte has a random value, a word's hash is the polynomial
of its bytes' values, and prefix sums give all words of the stream at once. Modulo 2**64 long words can be built that agree for
any base and values, so a word of ``LONG`` bytes or more has the xxh3 of its bytes instead; shorter ones agree by chance alone. Streams are worked on in
pieces of about ``PIECE`` bytes that end between words, so memory doesn't depend on the length of a text
(but for a single longer word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Fixed odd multipliers, one for each place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
SHIFT = np.uint64(31)
PIECE = 1 << 17
#: The polynomial's base and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * PLACES[0]
    return x ^ (x >> SHIFT)


def values_of(separators: set[int] | frozenset[int]) -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z, bytes that separate words have none."""
    values = np.random.default_rng(20_26).integers(1, 1 << 62, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


_VALUES = values_of(frozenset((0x20, *range(0x09, 0x0E))))
_powers = {b: np.ones(1, np.uint64) for b in (BASE, INVERSE)}
#: Bytes of a word that is hashed by itself.
LONG = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * PLACES[0]
    return x ^ (x >> SHIFT)


def values_of(separators: set[int] | frozenset[int]) -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z, bytes that separate words have none."""
    values = np.random.default_rng(20_26).integers(1, 1 << 62, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


_VALUES = values_of(frozenset((0x20, *range(0x09, 0x0E))))
_powers = {b: np.ones(1, np.uint64) for b in (BASE, INVERSE)}
#: The field, and two random places in it.
FIELD = np.uint64((1 << 31) - 1)
SPOTS = tuple(int(x) for x in np.random.default_rng(31_26).integers(1 << 20, (1 << 31) - 2, 2))
_field_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), remembered."""
    if len(_powers[base]) < n:
        powers = np.full(max(n, PIECE + 4096), base, np.uint64)
        powers[0] = 1
        _powers[base] = np.multiply.accumulate(powers)
    return _powers[base][:n]


def _pieces(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts the stream between texts, or in a text longer than a piece between words."""
    start, end = int(bounds[0]), int(bounds[-1])
    while start < end:
        cut = start + PIECE
        if cut >= end:
            cut = end
        else:
            text = int(np.searchsorted(bounds, cut, "right"))
            if bounds[text - 1] > start:
                cut = int(bounds[text - 1])
            else:
                last = int(bounds[text])
                while cut < last and not (blank := np.flatnonzero(~in_word[data[cut : min(last, cut + 4096)]])).size:
                    cut = min(last, cut + 4096)
                if cut < last:
                    cut += int(blank[0])
        yield start, cut
        start = cut


def word_hashes(texts: pa.Array, values: np.ndarray = _VALUES) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (or by other values), and where each text's words begin, with the end."""
    texts = texts.cast(pa.large_binary())
    _, offsets, buffer = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    if texts.null_count:
        raise ValueError("fill nulls first")
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    in_word = values != 0
    for lo, hi in _pieces(data, bounds, in_word):
        piece = data[lo:hi]
        sums = values[piece]
        sums *= _power(BASE, hi - lo)
        np.cumsum(sums, out=sums)
        word = in_word[piece]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo  # a text's first byte begins a word
        first[edges] = word[edges]
        begin = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:]
        edges = edges[edges > 0] - 1
        last[edges] = word[edges]
        end = np.flatnonzero(last)
        h = sums[end]
        h[begin > 0] -= sums[begin[begin > 0] - 1]
        h *= _power(INVERSE, hi - lo)[begin]
        h = mixed(h)
        for w in np.flatnonzero(end - begin >= LONG - 1).tolist():
            h[w] = xxhash.xxh3_64_intdigest(piece[begin[w] : end[w] + 1].tobytes().translate(_LOWER), 26)
        hashes.append(h)
        begins.append(begin + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)


def _all_shingles(h: np.ndarray) -> np.ndarray:
    """The hash of the five words from every word on."""
    n, k = len(h), len(PLACES)
    if n < k:
        return np.zeros(0, np.uint64)
    total = h[: n - k + 1] * PLACES[0]
    for j in range(1, k):
        total += h[j : n - k + 1 + j] * PLACES[j]
    return mixed(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its 5-word shingles; a shorter text is one shingle; without words the set is empty."""
    h, at = word_hashes(texts)
    every, k = _all_shingles(h), len(PLACES)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        n = hi - lo
        if n == 0:
            yield h[:0]
        elif n < k:
            yield mixed(np.array([(h[lo:hi] * PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            total = np.sort(every[lo : hi - k + 1])
            new = np.ones(len(total), bool)
            np.not_equal(total[1:], total[:-1], out=new[1:])
            yield total[new]
