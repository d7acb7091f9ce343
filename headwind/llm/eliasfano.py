"""Elias-Fano coding of a non-decreasing sequence, with a sampled select structure.

n values below u + 1 take about n * (2 + log2(u / n)) bits: the low bits of each in a packed array, the high bits
in unary in a bit vector, and the places of every SAMPLE-th one, from which select() finds a value without decoding
the others.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxIII")


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: non-decreasing, not negative."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, int(v[-1] // np.uint64(n)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, 0, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview | bytes) -> tuple[EliasFano, int]:
        """The structure and how many bytes it takes."""
        n, _, low_bits, low, high, samples = _HEAD.unpack_from(data)
        a = _HEAD.size
        parts = [np.frombuffer(data, np.uint8, low, a), np.frombuffer(data, np.uint8, high, a + low), np.frombuffer(bytes(data[a + low + high : a + low + high + 4 * samples]), "<u4")]
        return cls(n, low_bits, *parts), a + low + high + 4 * samples

    def _lows(self, first: int, past: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(past - first, np.uint64)
        a, b = first * self.low_bits, past * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(1, dtype=np.uint64)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n)).astype(np.int64)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if left < len(ones):
                place = byte * 8 + int(ones[left])
                return ((place - i) << self.low_bits) | int(self._lows(i, i + 1)[0])
            left, byte, skip = left - len(ones), byte + 64, 0

    def __len__(self) -> int:
        return self.n
