"""Words of whole texts as places and hashes in the bytes of a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from labelkite.llm import bytehash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

def _alphanumeric() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased."""
    kind = np.zeros(256, bool)
    kind[0x30:0x3A] = kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:] = True
    return kind


def _solid() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]``."""
    kind = np.ones(256, bool)
    kind[[0x20, *range(0x09, 0x0E)]] = False
    return kind


ALPHANUMERIC, SOLID = _alphanumeric(), _solid()


@dataclass
class Words:
    raw: np.ndarray  # lower-cased bytes of the texts
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # the text of each word
    hash: np.ndarray
    n_rows: int

    @classmethod
    def of(cls, raw: np.ndarray, borders: np.ndarray, kind: np.ndarray) -> "Words":
        low = LOWER[raw]
        starts, ends = bytehash.runs(kind[low], borders)
        row = np.searchsorted(borders, starts, "right") - 1
        return cls(low, starts, ends, row, bytehash.hashes(low, starts, ends), len(borders) - 1)

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def starting(self, k: int) -> np.ndarray:
        """First word of each run of ``k`` words that lies in one text."""
        n = max(len(self.hash) - k + 1, 0)
        return np.flatnonzero(self.row[:n] == self.row[k - 1 :]) if n else np.zeros(0, np.int64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``k`` words that lies in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = self.starting(k)
        steps = bytehash.places(k) | np.uint64(1)
        sums = np.full(n, k, np.uint64)
        for j in range(k):  # over all words, as neighbours in memory are cheaper than a choice of them
            sums += self.hash[j : n + j] * steps[j]
        return first, bytehash.mixed(sums[first])

    def text(self, first: int, k: int) -> bytes:
        """``k`` words, joined by one space."""
        at = range(first, first + k)
        return b" ".join([self.raw[self.starts[i] : self.ends[i]].tobytes() for i in at])
