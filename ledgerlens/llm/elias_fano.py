"""Elias-Fano code of a rising sequence: n (2 + log2(U / n)) bits, and any value without decoding the rest.

The low bits of each value lie packed side by side; its high bits are one set bit in a unary bitmap.  The
place of every ``STEP``-th set bit is kept, so value i is found from the nearest kept place.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 64
HEAD = struct.Struct("<IBIII")


def encode(values: np.ndarray) -> bytes:
    """Bytes of a sequence of non-negative integers that never falls (repeats are fine, empty too)."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return HEAD.pack(0, 0, 0, 0, 0)
    width = max(0, int(int(values[-1]) // n).bit_length() - 1)
    low = np.packbits((values[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little")
    place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(place[-1]) + 1, np.uint8)
    bits[place] = 1
    high, kept = np.packbits(bits, bitorder="little"), place[::STEP].astype("<u4")
    return HEAD.pack(n, width, len(low), len(high), len(kept)) + low.tobytes() + high.tobytes() + kept.tobytes()


class Sequence:
    """Read access to encoded values."""

    def __init__(self, data: bytes):
        self.n, self.width, n_low, n_high, n_kept = HEAD.unpack_from(data)
        self.low = np.frombuffer(data, np.uint8, n_low, HEAD.size)
        self.high = np.frombuffer(data, np.uint8, n_high, HEAD.size + n_low)
        self.kept = np.frombuffer(data, "<u4", n_kept, HEAD.size + n_low + n_high)

    def __len__(self) -> int:
        return self.n

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.uint64)
        start, stop = first * self.width, (first + count) * self.width
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
        return bits.reshape(count, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Value i, from the kept place before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.kept[i // STEP])
        stop = int(self.kept[i // STEP + 1]) if i // STEP + 1 < len(self.kept) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : stop // 8 + 1], bitorder="little")) + at // 8 * 8
        place = int(ones[np.searchsorted(ones, at) + i % STEP])
        return ((place - i) << self.width) + int(self._low(i, 1)[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) + self._low(0, self.n)
