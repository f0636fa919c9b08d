"""Benchmark passages in documents: a broadcast hash set of the benchmark's word windows.

Every window of 10 consecutive words of an item (or all words of an item that has fewer) is hashed;
the set is broadcast, each document's windows are looked up in it, and every hit is verified word by
word. A benchmark with more than ``block`` windows is taken in several blocks, each broadcast and
matched with all documents; the blocks' spans are united.

Nulls: a null text has no words, as an empty one; a null item id never appears among the found items. The
windows of such an item are made with ``unnamed``; they hit like all others, and ``n_items`` counts all
items without an id as one.
Items without words match nothing. An empty benchmark leaves every document clean. Repeated items are
each found; repeated documents each have their row. Other columns are kept by ``decontaminate`` and
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm.bytehash import slices, text_bytes
from labelkite.llm.tables import free_name
from labelkite.llm.words import ALPHANUMERIC, Words
from labelkite.shared import written

WINDOW = 10
BLOCK = 250_000  # windows that are broadcast at a time: some 30 MB

SPAN = "struct<first:int,last:int,begin:int,end:int>"
FOUND = f"struct<n_words:long,spans:array<{SPAN}>,items:array<long>>"
ARROW_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])


def benchmark_windows(
    items: DataFrame, window: int = WINDOW, id: str = "item_id", text: str = "text", unnamed: bool = False
) -> DataFrame:
    """Stored ``(item_id, n, hash, words)``: each distinct window of each item, with ``unnamed`` also of those without an id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            raw, borders = text_bytes(batch.column(1))
            words = Words.of(raw, borders, ALPHANUMERIC)
            sizes = words.per_row()
            rows = []
            for n in {min(window, s) for s in sizes.tolist()} - {0}:
                for first, h in zip(*(x.tolist() for x in words.windows(n))):
                    row = int(words.row[first])
                    if n == min(window, sizes[row]):
                        rows.append((keys[row], n, h - (1 << 64) if h >> 63 else h, words.text(first, n)))
            columns = zip(*rows) if rows else [[]] * 4
            types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "n", "hash", "words"]
            )

    rows = items.select(F.col(id).cast("long").alias("item_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(cut, "item_id long, n int, hash long, words binary")
    found = found if unnamed else found.where("item_id is not null")
    return written(found.distinct(), "benchmark-windows")


class Block:
    """A block of windows, by length: hashes in order, and the words and items of each."""

    def __init__(self, rows: list):
        self.by_length: dict[int, tuple[np.ndarray, dict]] = {}
        for n in sorted({r["n"] for r in rows}):
            windows: dict[int, dict[bytes, list[int]]] = {}
            for r in rows:
                if r["n"] == n:
                    same = windows.setdefault(r["hash"] % (1 << 64), {})
                    same.setdefault(bytes(r["words"]), []).append(r["item_id"])
            self.by_length[n] = np.array(sorted(windows), np.uint64), windows

    def match(self, raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, dict, dict]:
        """Words of each row, and by row the spans of hit words and the items found."""
        words = Words.of(raw, borders, ALPHANUMERIC)
        hits = np.zeros(len(words.hash) + 1, np.int64)
        items: dict[int, set] = {}
        for n, (known, windows) in self.by_length.items():
            first, h = words.windows(n)
            spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in np.flatnonzero(known[spot] == h).tolist():
                at = int(first[i])
                found = windows[int(h[i])].get(words.text(at, n))
                if found:
                    hits[at] += 1
                    hits[at + n] -= 1
                    items.setdefault(int(words.row[at]), set()).update(found)
        sizes = words.per_row()
        first_word = np.cumsum(sizes) - sizes
        spans: dict[int, list] = {}
        hit = np.flatnonzero(np.cumsum(hits[:-1]) > 0)
        for at in np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(words.row[hit]) > 0)) + 1):
            if len(at):
                row = int(words.row[at[0]])
                a, b = int(words.starts[at[0]]), int(words.ends[at[-1]])
                before = _characters(raw[borders[row] : a])
                own = at - first_word[row]
                spans.setdefault(row, []).append(
                    {"first": own[0], "last": own[-1], "begin": before, "end": before + _characters(raw[a:b])}
                )
        return sizes, spans, items


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _matcher(broadcast):
    @F.arrow_udf(FOUND)
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = broadcast.value
        for column in texts:
            raw, borders = text_bytes(column)
            sizes, spans, items = [], [], []
            for a, b in slices(borders):
                n, s, i = block.match(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
                sizes += n.tolist()
                spans += [s.get(k, []) for k in range(b - a)]
                items += [sorted(i.get(k, ()), key=lambda x: (x is None, x)) for k in range(b - a)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(ARROW_SPAN)),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                ["n_words", "spans", "items"],
            )

    return found


def united(spans: Column) -> Column:
    """Spans in order, with those that overlap made one."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(f"array<{SPAN}>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"),
                        F.element_at(done, -1)["begin"].alias("begin"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def with_hits(docs: DataFrame, windows: DataFrame, text: str, name: str, block: int = BLOCK) -> DataFrame:
    """The documents with a column ``name``: words, united spans of hit words, items found (last a null for those without an id).

    No shuffle. One block of windows is broadcast at a time; between blocks the rows are stored, so
    that no task holds two.
    """
    n = max(1, -(-windows.count() // block))
    rows = docs
    for i in range(n):
        part = Block(windows.where(F.pmod("hash", F.lit(n)) == i).collect())
        found = _matcher(windows.sparkSession.sparkContext.broadcast(part))(F.col(text))
        if i == 0:
            rows = docs.withColumn(name, found)
            continue
        more = free_name(rows, "more")
        rows = written(rows, "passages").withColumn(more, found)
        whole = F.struct(
            F.col(name)["n_words"].alias("n_words"),
            united(F.concat(F.col(name)["spans"], F.col(more)["spans"])).alias("spans"),
            F.array_sort(F.array_union(F.col(name)["items"], F.col(more)["items"])).alias("items"),
        )
        rows = rows.withColumn(name, whole).drop(more)
    return rows


def hits(
    docs: DataFrame, windows: DataFrame, id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, n_items, spans)`` of every document."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    found = with_hits(rows, windows, "text", "found", block)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    items = F.array_compact("found.items").alias("items")
    n_items = F.size("found.items").cast("long").alias("n_items")
    return found.select("doc_id", "found.n_words", n_hit.alias("n_hit"), items, n_items, "found.spans")


def decontaminate(
    docs: DataFrame, windows: DataFrame, remove: str = "documents", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Without the documents that have a hit (``documents``), or with the hit words cut out (``spans``)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"cannot remove {remove!r}")
    name = free_name(docs, "found")
    found = with_hits(docs, windows, text, name, block)
    spans = F.col(name)["spans"]
    if remove == "documents":
        return found.where(F.size(spans) == 0).drop(name)
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.length(text)))
    kept = F.zip_with(begins, ends, lambda a, b: F.col(text).substr(a + 1, b - a))
    cut = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.array_join(kept, ""))
    return found.withColumn(text, cut).drop(name)
