"""Elias-Fano code of a non-decreasing sequence, with select.

Each value is split in low bits, stored as they are, and high bits, stored in unary in a bit vector: the i-th one stands at place
(high part + i). Every `SAMPLE`-th one's place is kept as a 32-bit number, so a value costs 2 + log2(universe / n) bits and a little,
and any one of them is found by scanning a few bytes, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBIII")  # values, universe, low bits, bytes of low, high and samples


def encode(values: np.ndarray, universe: int) -> bytes:
    """`values` do not decrease and lie in 0..universe, which is below 2^32."""
    n = len(values)
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    values = values.astype(np.uint64)
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    low_part = np.packbits(bits.ravel(), bitorder="little").tobytes()
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((universe >> low) + n + 1, np.uint8)
    high[places] = 1
    high_part = np.packbits(high, bitorder="little").tobytes()
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(n, universe, low, len(low_part), len(high_part), len(samples)) + low_part + high_part + samples


class EliasFano:
    def __init__(self, raw: bytes | memoryview) -> None:
        self.n, self.universe, self.low, a, b, c = _HEAD.unpack_from(raw)
        at = _HEAD.size
        self._low = np.frombuffer(raw, np.uint8, a, at)
        self._high = np.frombuffer(raw, np.uint8, b, at + a)
        self._samples = np.frombuffer(raw, "<u4", c // 4, at + a + b)
        self.size = at + a + b + c

    def __getitem__(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self._samples[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        word = int(self._high[byte]) >> place % 8 << place % 8
        while left >= (ones := word.bit_count()):
            left, byte = left - ones, byte + 1
            word = int(self._high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        start = i * self.low
        raw = int.from_bytes(self._low[start // 8 : (start + self.low + 7) // 8].tobytes(), "little")
        return high << self.low | raw >> start % 8 & (1 << self.low) - 1

    def values(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self._low, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        low = (bits.astype(np.int64) << np.arange(self.low)).sum(1) if self.low else np.zeros(self.n, np.int64)
        return (places - np.arange(self.n) << self.low) + low
