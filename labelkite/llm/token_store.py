"""Token ids of a corpus in a binary format: one row of ids, document borders in Elias-Fano code.

A store is a folder of Parquet files whose rows are blocks. A block has the ids of some documents one
after the other (two bytes each where the vocabulary allows it, else four), their borders as an
Elias-Fano code with select samples, and the document ids, ascending through the store. Spark's own
writer commits the files, so a lost executor leaves no half block.

Nulls: a null text is empty and has only the end id. A null document id sorts first. Rows with one
document id lie side by side, by text. An empty table makes an empty store. A text longer than a
block has a block of its own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelkite.llm.bytehash import slices, text_bytes
from labelkite.llm.elias_fano import EliasFano
from labelkite.llm.pieces import PieceCoder

BLOCK_IDS = 1 << 20

BLOCKS = (
    "part int, part_start long, n_docs int, n_ids long, first_doc long, last_doc long, width int, "
    "doc_ids array<long>, ids binary, low_bits int, low binary, high binary, samples binary"
)
NAMES = [f.split(" ")[0] for f in BLOCKS.split(", ")]
TYPES = [
    pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
    pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(),
]


def _block(part: int, start: int, docs: list, ids: list[np.ndarray], sizes: list[int], width: int):
    borders = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]))
    known = [d for d in docs if d is not None]
    row = [
        part, start, len(docs), int(sum(sizes)), min(known, default=None), max(known, default=None), width,
        docs, np.concatenate(ids).astype(f"<u{width}").tobytes(),
        borders.low_bits, borders.low, borders.high, borders.samples,
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES)], NAMES)


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode whole texts, end each document with ``end_id`` and store them by ascending id.

    ``tokenizer`` is a file of the tokenizers library that each executor can read. A range shuffle
    by id puts the documents in order; a task holds one block at a time.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.of_worker(tokenizer)
        width = 2 if max(coder.full.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, start = TaskContext.get().partitionId(), 0
        waiting: list = []
        ids: list = []
        sizes: list = []
        held = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            raw, borders = text_bytes(batch.column(1))
            for a, b in slices(borders):
                flat, counts = coder.encode(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
                at = 0
                for key, n in zip(keys[a:b], counts.tolist()):
                    waiting.append(key)
                    ids += [flat[at : at + n], [end_id]]
                    sizes.append(n + 1)
                    held += n + 1
                    at += n
                    if held >= block_ids:
                        yield _block(part, start, waiting, ids, sizes, width)
                        start, held, waiting, ids, sizes = start + held, 0, [], [], []
        if waiting:
            yield _block(part, start, waiting, ids, sizes, width)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # Ids of two bytes press well, and one block is one row.
    ordered.mapInArrow(encoded, BLOCKS).write.option("compression", "zstd").parquet(path)


def _borders(n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> EliasFano:
    return EliasFano(n + 1, low_bits, low, high, samples)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            code = _borders(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"])
            borders = np.array([code.select(k) for k in range(r["n_docs"] + 1)])
            ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
            for a in range(0, r["n_docs"], 1000):
                b = min(a + 1000, r["n_docs"])
                own = 4 * (borders[a : b + 1] - borders[a])
                data = pa.py_buffer(ids[borders[a] : borders[b]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]] * (b - a), pa.int32()),
                        pa.array(r["doc_ids"][a:b], pa.int64()),
                        pa.array(r["part_start"] + borders[a:b], pa.int64()),
                        pa.array(np.diff(borders[a : b + 1]), pa.int64()),
                        pa.Array.from_buffers(
                            pa.binary(), b - a, [None, pa.py_buffer(own.astype(np.int32).tobytes()), data]
                        ),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all documents, read back from the files.

    ``start`` counts the ids of all documents before; ``ids`` are unsigned 32-bit, little-endian.
    The parts' totals are one row for each task that wrote.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = blocks.select("part", "part_start", "n_docs", "width", "doc_ids", "ids", "low_bits", "low", "high", "samples")
    found = own.mapInArrow(_documents, "part int, doc_id long, start long, n_tokens long, ids binary")
    return found.join(offsets, "part").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids"
    )


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of a few documents: their blocks only, and select only inside a block."""
    wanted = set(doc_ids)
    if not wanted:
        return spark.createDataFrame([], "doc_id long, ids binary")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                borders = _borders(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"])
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                hits = [k for k, d in enumerate(r["doc_ids"]) if d in wanted]
                spans = [ids[borders.select(k) : borders.select(k + 1)].astype("<u4").tobytes() for k in hits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_ids"][k] for k in hits], pa.int64()), pa.array(spans, pa.binary())],
                    ["doc_id", "ids"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(path).where(f"last_doc >= {min(wanted)} AND first_doc <= {max(wanted)}")
    asked = F.array(*[F.lit(d) for d in sorted(wanted)])
    near = F.exists(asked, lambda d: (F.col("first_doc") <= d) & (F.col("last_doc") >= d))
    return blocks.where(near).mapInArrow(chosen, "doc_id long, ids binary")
