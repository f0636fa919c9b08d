"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

A task packs the documents of its part of the scan, one after the other. Whole windows are cut off a
long document; the rest of it goes, in one piece, to the open window (or a new one) that makes the sum
of squared numbers of windows by fill level smallest. The level array has the number of open windows
at each fill. Where the task's stream ends, the open windows are closed: those with the least are cut
to fill those with the most, and what is left of the last is cut at powers of two, which need no
padding.

Nulls: a null text is empty and has only the end id. Ids may be null or repeat: each row is a document.
An empty table gives no pieces. Memory is bounded by the open windows, at most a few for each level.
Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.bytehash import slices, text_bytes
from labelkite.llm.pieces import PieceCoder

WINDOW = 1024
OUT_ROWS = 4096

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = [f.split(" ")[0] for f in PIECES.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


class Packer:
    """The open windows of one task. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)  # open windows by fill
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # their pieces
        self.done: list[list] = []  # closed windows

    def best_level(self, n: int) -> int:
        """The fill level to put ``n`` tokens on; 0 opens a window. The fullest of equals is taken."""
        last = self.size - n
        now, then = self.levels[: last + 1], self.levels[n:]
        change = 2 * then + 1
        change[last] = 0  # a full window is no longer open
        change[1:] += 1 - 2 * now[1:]
        change[1:][now[1:] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.size
        for a in range(0, whole, self.size):
            self.done.append([(doc_id, a, ids[a : a + self.size], n)])
        if whole < n:
            self._place((doc_id, whole, ids[whole:].copy(), n))

    def _place(self, piece: tuple) -> None:
        n = len(piece[2])
        level = self.best_level(n)
        window = []
        if level:
            self.levels[level] -= 1
            window = self.open[level].pop()
        window.append(piece)
        if level + n == self.size:
            self.done.append(window)
        else:
            self.levels[level + n] += 1
            self.open[level + n].append(window)

    def close(self) -> None:
        """Fill the fullest open windows from the others; cut what is left at powers of two."""
        windows = [w for level in reversed(self.open) for w in level]
        self.levels[:], self.open = 0, [[] for _ in range(self.size + 1)]
        total = sum(len(p[2]) for w in windows for p in w)
        full = total // self.size
        loose = deque(p for w in windows[full:] for p in w)
        rest = [1 << k for k in reversed(range(self.size.bit_length())) if total % self.size >> k & 1]
        for window, goal in zip(windows[:full] + [[] for _ in rest], [self.size] * full + rest):
            missing = goal - sum(len(p[2]) for p in window)
            while missing:
                doc_id, start, ids, n = loose.popleft()
                window.append((doc_id, start, ids[:missing], n))
                if len(ids) > missing:
                    loose.appendleft((doc_id, start + missing, ids[missing:], n))
                missing -= len(window[-1][2])
            self.done.append(window)


def _batch(windows: list[list], first: int) -> pa.RecordBatch:
    rows = []
    for i, window in enumerate(windows):
        offset = 0
        for doc_id, start, ids, n in window:
            rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, first + i, offset))
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    size: int = WINDOW,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``.

    Each document's ids are those of the whole text and ``end_id``. A sequence has ``size`` tokens, or
    fewer by a power of two. No shuffle: the sequence number is the task's number and a count.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = PieceCoder.of_worker(tokenizer), Packer(size)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0).to_pylist()
            raw, borders = text_bytes(batch.column(1))
            for a, b in slices(borders):
                flat, counts = coder.encode(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
                at = 0
                for key, n in zip(keys[a:b], counts.tolist()):
                    packer.add(key, np.append(flat[at : at + n], np.uint32(end_id)))
                    at += n
                    if len(packer.done) >= OUT_ROWS:
                        yield _batch(packer.done, number)
                        number, packer.done = number + len(packer.done), []
        packer.close()
        if packer.done:
            yield _batch(packer.done, number)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(packed, PIECES)
