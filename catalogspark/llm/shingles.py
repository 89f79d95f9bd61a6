"""Hashed word shingles of texts, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PLANES = 4  # bits kept of each bin for a quick look at two signatures
PIECE_BYTES = 1 << 20  # texts are hashed together up to this size; a longer text alone
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts that are hashed together: up to PIECE_BYTES, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _BLANK, prefixes: tuple[int, ...] = (),
) -> tuple[np.ndarray, ...]:
    """Hashes of all words, per text the index of its first word (one more at the end), then
    the hashes of the words' first bytes for each length in ``prefixes`` (0 for shorter words)."""
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~gaps[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = offsets[:-1]
    starts = starts[starts < len(data)]
    first[starts] = solid[starts]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *[np.zeros(0, np.uint64)] * len(prefixes)
    heads = np.flatnonzero(first[at])
    sizes = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, sizes)
    values = _BYTE[_LOWER[data[at]]] * _PLACE[place & 0xFFFF]
    words = mixed(np.add.reduceat(values, heads) + sizes.astype(np.uint64) * _TURN[63])
    stems = []
    for k in prefixes:
        stem = mixed(np.add.reduceat(np.where(place < k, values, np.uint64(0)), heads) + _TURN[k])
        stems.append(np.where(sizes >= k, stem, np.uint64(0)))
    return words, np.searchsorted(at[heads], offsets), *stems


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words.

    Words are what lies between blanks, with A-Z lower-cased. A text of fewer words has its
    whole sequence as one shingle, a text without words none.
    """
    data, offsets = buffers(column)
    for i, j in pieces(offsets):
        words, bounds = word_hashes(data, offsets[i:j + 1])
        many = max(len(words) - width + 1, 0)
        grams = np.zeros(many, np.uint64)
        for k in range(width):
            grams += words[k:k + many] * _TURN[k]
        grams = mixed(grams)
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = b - a
            if n >= width:
                yield np.unique(grams[a:b - width + 1])
            elif n:
                yield mixed(np.sum(words[a:b] * _TURN[8:8 + n], keepdims=True) + _TURN[32 + n])
            else:
                yield np.zeros(0, np.uint64)


class OnePermutation:
    """One-permutation MinHash with optimal densification, folded into band hashes.

    The top bits of a shingle's hash choose its bin, the rest ranks it there. An empty bin
    walks its own fixed random order of the bins and copies the first filled one, so two
    texts with the same filled bins copy alike.
    """

    def __init__(self, bins: int = 128, rows: int = 4):
        rng = np.random.default_rng(128)
        self.bins, self.rows = bins, rows
        self.bounds = (np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1))
        self.walk = np.stack([rng.permutation(bins) for _ in range(bins)])
        self.turn = rng.integers(1, 1 << 63, (bins // rows, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest hash of every bin, from a sorted, non-empty set."""
        low = np.searchsorted(shingles, self.bounds)
        filled = np.diff(np.append(low, len(shingles))) > 0
        source = np.arange(self.bins)
        empty = np.flatnonzero(~filled)
        if len(empty):
            walk = self.walk[empty]
            source[empty] = walk[np.arange(len(empty)), np.argmax(filled[walk], axis=1)]
        return shingles[low[source]]

    def bands(self, signature: np.ndarray) -> np.ndarray:
        """One hash per band."""
        return mixed((signature.reshape(-1, self.rows) * self.turn).sum(axis=1, dtype=np.uint64) + self.turn[:, 0])

    def planes(self, signature: np.ndarray) -> np.ndarray:
        """Four low bits of every bin, one bit of all bins after the other, as 64-bit numbers."""
        bits = mixed(signature)[None, :] >> np.arange(PLANES, dtype=np.uint64)[:, None] & np.uint64(1)
        return np.packbits(bits.astype(np.uint8), axis=1).reshape(-1).view(np.int64)
