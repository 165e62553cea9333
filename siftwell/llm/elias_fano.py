"""Elias-Fano code of a non-decreasing integer sequence, with select.

n values below u take n * (2 + log2(u / n)) bits and a little: the low bits of each value stand side by side, the
high bits are one bit vector in which value i sets bit high(i) + i. The place of every SAMPLE-th one is kept as a
32-bit number, so that select(i) looks at a short stretch of that vector.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

SAMPLE = 512
_HEAD = struct.Struct("<QQBI")


def _bits(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: Sequence[int] | np.ndarray, base: int = 0) -> bytes:
    """values: non-decreasing, none below base."""
    rel = (np.asarray(values, dtype=np.int64) - np.int64(base)).astype(np.uint64)
    n = len(rel)
    u = int(rel[-1]) + 1 if n else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    high = (rel >> np.uint64(low)).astype(np.int64)
    ones = high + np.arange(n)
    vector = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
    vector[ones] = 1
    upper = np.packbits(vector, bitorder="little").tobytes()
    lower = _bits(rel & np.uint64((1 << low) - 1), low)
    return _HEAD.pack(n, u, low, len(upper)) + struct.pack("<q", base) + ones[::SAMPLE].astype("<u4").tobytes() + upper + lower


class EliasFano:
    """Reads what encode() wrote, without unpacking it."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        self.n, self.u, self.low, size = _HEAD.unpack_from(data)
        (self.base,) = struct.unpack_from("<q", data, _HEAD.size)
        at = _HEAD.size + 8
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        self.upper = np.frombuffer(data, np.uint8, size, at)
        at += size
        self.lower = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at)
        self.bytes = at + len(self.lower)

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        start = i * self.low
        raw = int.from_bytes(self.lower[start >> 3 : (start + self.low + 7) >> 3].tobytes(), "little")
        return raw >> (start & 7) & (1 << self.low) - 1

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SAMPLE
        start = int(self.samples[k])
        stop = int(self.samples[k + 1]) + 1 if k + 1 < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :]
        place = start + int(np.flatnonzero(bits)[i - k * SAMPLE])
        return self.base + ((place - i) << self.low | self._low(i))

    def select_run(self, first: int, stop: int) -> np.ndarray:
        """Values number first to stop - 1: the samples lead to the first, and only that stretch is unpacked."""
        if not 0 <= first <= stop <= self.n:
            raise IndexError((first, stop))
        if first == stop:
            return np.zeros(0, np.int64)
        k = first // SAMPLE
        last = -(-stop // SAMPLE)
        start = int(self.samples[k])
        end = int(self.samples[last]) + 1 if last < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :]
        i = np.arange(first, stop)
        high = start + np.flatnonzero(bits)[i - k * SAMPLE] - i
        low = np.zeros(len(i), np.int64)
        if self.low:
            at = first * self.low
            raw = np.unpackbits(self.lower[at >> 3 : (stop * self.low + 7) >> 3], bitorder="little")[at & 7 :][: len(i) * self.low]
            low = raw.reshape(len(i), self.low).astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return np.int64(self.base) + (high << self.low | low)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n].astype(np.uint64)
        high = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        low = np.zeros(self.n, np.uint64)
        if self.low and self.n:
            bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            low = (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high | low).astype(np.int64) + np.int64(self.base)
