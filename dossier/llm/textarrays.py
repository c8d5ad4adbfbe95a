"""Texts of an Arrow batch as flat numpy arrays: bytes, words, 64-bit word and shingle hashes.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``, which is the run of characters outside them, as
UTF-8 never uses those bytes inside a longer character. Hashes mix in eight bytes at a time, without the
algebra by which polynomials collide; equal words have equal hashes on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: Multipliers of the lanes of a hash; keeps the low bytes of a little-endian word.
_LANES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of a span beyond which it is hashed by the xxhash library.
_LONG = 64
#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, cuts: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without the bytes marked in ``between``), and for each cut (ascending byte position) the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(cuts), np.int64)
    inside = ~between[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    start[inner] |= inside[inner]
    end[inner - 1] |= inside[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, cuts)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: its eight-byte words are mixed in one after the other. Two lanes make up 128 bits."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    times, n = U(_LANES[lane]), e - s
    h = mix((word[s] & _LOW_BYTES[np.minimum(n, 8)]) ^ (n.astype(U) * times))
    left, k = np.flatnonzero(n > 8), 8
    while len(left) and k < _LONG:
        h[left] = mix((h[left] * times) ^ (word[s[left] + k] & _LOW_BYTES[np.minimum(n[left] - k, 8)]))
        k += 8
        left = left[n[left] > k]
    for i in left.tolist():
        h[i] = U(xxhash.xxh3_64_intdigest(data[s[i] : e[i]].tobytes(), seed=lane))
    return h


def shingles(h: np.ndarray, cuts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles of each unit (words ``cuts[i]:cuts[i+1]``), repeats included, and the units' cuts in them.

    A unit of fewer than ``k`` words, but one at least, has its whole sequence as one shingle.
    """
    n = np.diff(cuts)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=at[1:])
    if not at[-1]:
        return np.zeros(0, U), at
    first = np.arange(at[-1]) - np.repeat(at[:-1] - cuts[:-1], m)
    short = np.repeat(n < k, m)
    out = np.zeros(at[-1], U)
    padded = np.concatenate([h, np.zeros(k, U)])
    last = np.repeat(cuts[1:], m)
    for i in range(k):
        x = padded[first + i]
        if short.any():
            x = np.where(short & (first + i >= last), U(0), x)
        out = out * U(_BASE) + x
    return mix(out), at
