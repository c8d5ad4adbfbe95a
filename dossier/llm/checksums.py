"""CRC-32 of many byte spans at once, and of their joins, on flat numpy arrays.

The checksum of A followed by B is that of A carried over B's length, xor that of B. Carrying is linear over bits, so it is read from
tables, one for each of a value's four bytes and each length up to ``REACH``.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

#: Bytes that one look into the tables carries over; a longer span takes several.
REACH = 127
_POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32
_LONG = 64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte's step, and for each length the tables that carry a value over it (flat: length, byte of the value, its content)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
    carry = np.empty((REACH + 1, 1024), np.uint32)
    carry[0] = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for n in range(1, REACH + 1):
        carry[n] = step[carry[n - 1] & 255] ^ (carry[n - 1] >> 8)
    return step, carry.ravel()


def span_crcs(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte span."""
    step, _ = _tables()
    n = e - s
    out = np.full(len(s), 0xFFFFFFFF, np.uint32)
    short = n <= _LONG
    i = np.flatnonzero(short & (n > 0))
    order = np.argsort(-n[i], kind="stable")  # longest first: those with a k-th byte are a prefix
    i, length = i[order], -np.sort(-n[i])
    at, value = s[i], out[i]
    for k in range(int(length[0]) if len(i) else 0):
        m = int(np.searchsorted(-length, -k, side="left"))
        value[:m] = step[(value[:m] ^ data[at[:m] + k]) & 255] ^ (value[:m] >> 8)
    out[i] = value
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(~short).tolist():
        out[k] = zlib.crc32(data[s[k] : e[k]].tobytes())
    return out


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each ``first`` span followed by a ``second`` one of ``length`` bytes, from the two spans' own."""
    _, carry = _tables()
    first, left = first.copy(), length.astype(np.int64)
    far = np.flatnonzero(left > REACH)
    while len(far):
        first[far] = _carried(carry, first[far], np.full(len(far), REACH))
        left[far] -= REACH
        far = far[left[far] > REACH]
    return _carried(carry, first, left) ^ second


def _carried(carry: np.ndarray, value: np.ndarray, length: np.ndarray) -> np.ndarray:
    base = length << 10
    return carry[base + (value & 255)] ^ carry[base + 256 + ((value >> 8) & 255)] ^ carry[base + 512 + ((value >> 16) & 255)] ^ carry[base + 768 + (value >> 24)]
