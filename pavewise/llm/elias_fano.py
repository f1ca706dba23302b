"""Elias-Fano coding of non-decreasing integers with select.

n values below u take about n * (2 + log2(u / n)) bits: the low bits side by side, the high bits in unary. Select finds the
k-th one of the unary part from a sample for every 256th one, so no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"EFI1"
STEP = 256
HEAD = struct.Struct("<4sBxxxQqQII")


class EliasFano:
    """values[i] = base + (high << low_bits | low)."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        if not len(v):
            return cls(0, 0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, "<u4"))
        if (np.diff(v) < 0).any():
            raise ValueError("values must not decrease")
        base = int(v[0])
        u = (v - base).astype(np.uint64)
        bits = max(0, (int(u[-1]) // len(v)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits((u[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.empty(0, np.uint8)
        ones = (u >> np.uint64(bits)).astype(np.int64) + np.arange(len(v))
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(len(v), base, bits, low, np.packbits(unary, bitorder="little"), ones[::STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = HEAD.pack(MAGIC, self.low_bits, self.n, self.base, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        magic, bits, n, base, a, b, c = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano block")
        at = HEAD.size
        return cls(n, base, bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c, at + a + b))

    def _low(self, k: int) -> int:
        bits = self.low_bits
        if not bits:
            return 0
        first = k * bits
        word = int.from_bytes(self.low[first >> 3 : (first + bits + 7) >> 3].tobytes(), "little")
        return word >> (first & 7) & ((1 << bits) - 1)

    def select(self, k: int) -> int:
        """The k-th value, from a sample and a short scan of the unary part."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // STEP]), k % STEP
        start = at >> 3
        step = 256
        seen = -int(np.unpackbits(self.high[start : start + 1], bitorder="little")[: at & 7].sum())
        while True:
            bits = np.unpackbits(self.high[start : start + step], bitorder="little")
            ones = np.flatnonzero(bits)
            if len(ones) + seen > left:
                where = (start << 3) + int(ones[left - seen])
                return self.base + ((where - k) << self.low_bits | self._low(k))
            seen += len(ones)
            start += step

    def all(self) -> np.ndarray:
        """Every value."""
        if not self.n:
            return np.empty(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high + self.base
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (high << self.low_bits | low) + self.base
