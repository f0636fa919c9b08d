"""Elias-Fano code of ascending numbers: about 2 + log2(largest / count) bits for each.

The low bits of each number lie side by side; the high bits are written in unary into one bit row,
so number ``i`` is ``(place of one i) - i`` there. Places of every 128th one let ``select`` start near
its goal, so one number is found without decoding the others and without a table of 64-bit offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 128


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, numbers: np.ndarray) -> "EliasFano":
        """Code ascending numbers, none below 0."""
        v = np.asarray(numbers, np.int64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(v[-1] // n).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low_bits)) & 1
        places = (v >> low_bits) + np.arange(n)
        row = np.zeros(int(places[-1]) + 1, np.uint8)
        row[places] = 1
        return cls(
            n,
            low_bits,
            np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(row, bitorder="little").tobytes(),
            places[::STEP].astype("<u4").tobytes(),
        )

    def all(self) -> np.ndarray:
        """The numbers."""
        if not self.n:
            return np.zeros(0, np.int64)
        row = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        high = np.flatnonzero(row)[: self.n] - np.arange(self.n)
        bits = np.unpackbits(
            np.frombuffer(self.low, np.uint8), count=self.n * self.low_bits, bitorder="little"
        ).reshape(self.n, self.low_bits)
        return (high << self.low_bits) + bits @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Number ``i``, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(np.frombuffer(self.samples, "<u4", 1, 4 * (i // STEP))[0])
        missing, byte = i % STEP, place // 8
        here = self.high[byte] >> (place % 8) << (place % 8)  # ones from the sample on
        while here.bit_count() <= missing:
            missing -= here.bit_count()
            byte += 1
            here = self.high[byte]
        for _ in range(missing):
            here &= here - 1
        place = 8 * byte + (here & -here).bit_length() - 1
        a, low = i * self.low_bits, 0
        for k in range(a, a + self.low_bits):
            low |= (self.low[k // 8] >> (k % 8) & 1) << (k - a)
        return ((place - i) << self.low_bits) | low
