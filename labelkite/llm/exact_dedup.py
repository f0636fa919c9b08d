"""Exact duplicates by a sharded Cuckoo-filter index of text digests.

The index is a stored table. Each shard holds the live digests of its part of the digest space in
buckets (the content) and a Cuckoo filter over them. A new digest asks the filter first; a hit is
verified against the content of its bucket, so a false hit never merges two texts. A filter without
room doubles and is filled again from the stored keys. Digests whose last document goes are deleted
from filter and content.

Nulls: a null text is an empty text; a null id loses to any other id. Rows that share text and id
are one document twice: they have the same result. An empty table gives an empty result. Other
columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm.tables import free_name, join_groups, only, shards
from labelkite.shared import written

SLOTS = 4
KICKS = 200
FIRST_BUCKETS = 256

# What a row of a shard's input is, in the order in which they are taken.
FILTER, ENTRY, ADD, SET = 0, 1, 2, 3

INDEX = "kind int, digest binary, keep_id long, group_size long, filter binary"


def normal_text(text: str) -> Column:
    """White space runs as one space; a null is an empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(normal_text(text), 256))


class CuckooFilter:
    """16-bit fingerprints of digests, four to a bucket, each in one of two buckets."""

    def __init__(self, buckets: int = FIRST_BUCKETS, cells: bytes | None = None):
        self.cells = array("H", bytes(2 * SLOTS * buckets) if cells is None else cells)
        self.buckets = len(self.cells) // SLOTS
        self.turn = 0

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.cells[i]:
                self.cells[i] = mark
                return True
        return False

    def contains(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        cells = self.cells
        return mark in cells[a * SLOTS : a * SLOTS + SLOTS] or mark in cells[b * SLOTS : b * SLOTS + SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False if no room was found; then a mark has been lost and the filter must be built anew."""
        mark, a, b = self.places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            i = b * SLOTS + self.turn
            mark, self.cells[i] = self.cells[i], mark
            b = self.other(b, mark)
            if self._put(b, mark):
                return True
        return False

    def delete(self, digest: bytes) -> None:
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.cells[i] == mark:
                    self.cells[i] = 0
                    return


class Shard:
    """Live digests of one shard: a filter, and the content by the digest's first bucket."""

    def __init__(self, cells: bytes | None = None):
        self.filter = CuckooFilter(cells=cells)
        self.content: dict[int, list[list]] = {}

    def _bucket(self, digest: bytes) -> list[list]:
        return self.content.setdefault(int.from_bytes(digest[2:10], "little") & 0xFFFF, [])

    def restore(self, digest: bytes, keep_id, size: int) -> None:
        """An entry whose mark is already in the stored filter."""
        self._bucket(digest).append([digest, keep_id, size])

    def find(self, digest: bytes) -> list | None:
        if not self.filter.contains(digest):
            return None
        return next((e for e in self._bucket(digest) if e[0] == digest), None)

    def add(self, digest: bytes, doc_id, n: int) -> None:
        entry = self.find(digest)
        if entry is None:
            self._bucket(digest).append([digest, doc_id, n])
            if not self.filter.insert(digest):
                self._grow()
            return
        if entry[1] is None or (doc_id is not None and doc_id < entry[1]):
            entry[1] = doc_id
        entry[2] += n

    def set(self, digest: bytes, keep_id, n: int) -> None:
        """What is left of a group after deletions; nothing left deletes the digest."""
        entry = self.find(digest)
        if entry is None:
            return
        if n:
            entry[1:] = [keep_id, n]
            return
        bucket = self._bucket(digest)
        bucket[:] = [e for e in bucket if e[0] != digest]
        self.filter.delete(digest)

    def _grow(self) -> None:
        size = self.filter.buckets
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(e[0]) for bucket in self.content.values() for e in bucket):
                return

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


def _combined(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    """One row of each digest in a batch, so that a hot text sends few rows to its shard.

    The number of shards goes along in an otherwise unused column.
    """
    for batch in batches:
        table = pa.Table.from_batches([batch])
        everything = pc.CountOptions("all")
        groups = table.group_by("digest").aggregate([("doc_id", "min"), ("doc_id", "count", everything)])
        n = groups.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ADD] * n, pa.int32()),
                    groups["digest"].combine_chunks(),
                    groups["doc_id_min"].combine_chunks(),
                    groups["doc_id_count"].combine_chunks(),
                    pa.array([str(n_shards).encode()] * n, pa.binary()),
                ],
                ["kind", "digest", "keep_id", "group_size", "filter"],
            )


def _index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, n_shards = None, None
    for batch in batches:
        for kind, digest, keep_id, n, note in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == FILTER:
                shard, n_shards = Shard(note), keep_id
                continue
            shard = shard or Shard()
            if kind == ENTRY:
                shard.restore(digest, keep_id, n)
            elif kind == ADD:
                n_shards = int(note)
                shard.add(digest, keep_id, n)
            else:
                shard.set(digest, keep_id, n)
    rows = shard.entries() if shard else iter(())
    some = [[ENTRY, *e, None] for _, e in zip(range(10_000), rows)]
    if some:
        some.insert(0, [FILTER, some[0][1], n_shards, None, shard.filter.cells.tobytes()])
    names = ["kind", "digest", "keep_id", "group_size", "filter"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    while some:
        columns = [pa.array(c, t) for c, t in zip(zip(*some), types)]
        yield pa.RecordBatch.from_arrays(columns, names)
        some = [[ENTRY, *e, None] for _, e in zip(range(10_000), rows)]


def _adds(keyed: DataFrame, n_shards: int) -> DataFrame:
    return keyed.select("doc_id", "digest").mapInArrow(lambda batches: _combined(batches, n_shards), INDEX)


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored ``(doc_id, digest)``: SHA-256 of the normalised text."""
    return written(docs.select(F.col(id).cast("long").alias("doc_id"), digest_of(text).alias("digest")), "digests")


def _in_shards(changes: DataFrame, n: int) -> DataFrame:
    """Deal the rows out by digest, apply each shard's changes, and store the new index.

    A filter row carries one live digest of its shard, which brings it to the shard's rows.
    """
    dealt = changes.repartition(n, "digest").sortWithinPartitions("kind", "digest", "keep_id")
    return written(dealt.mapInArrow(_index_shard, INDEX), "digest-index")


def _shards_of(index: DataFrame) -> int:
    """The number of shards that an index was built with; it stays, as the filters grow instead."""
    return index.where(F.col("kind") == FILTER).agg(F.max("keep_id")).first()[0] or shards(index)


def build(keyed: DataFrame, n_shards: int | None = None) -> DataFrame:
    """Index of ``(doc_id, digest)`` rows: entries ``(digest, keep_id, group_size)`` and filters."""
    n = n_shards or shards(keyed)
    return _in_shards(_adds(keyed, n), n)


def insert(index: DataFrame, keyed: DataFrame) -> DataFrame:
    """The index with more documents."""
    n = _shards_of(index)
    return _in_shards(index.unionByName(_adds(keyed, n)), n)


def delete(index: DataFrame, keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the documents whose ids are the one column of ``gone``.

    ``keyed`` are the indexed ``(doc_id, digest)`` rows. Only groups that lose a document are
    counted again; a group without documents leaves the index.
    """
    lost = only(keyed, gone, "doc_id").select("digest").distinct()
    unwanted = gone.toDF("_gone").distinct().withColumn("_hit", F.lit(1))
    stays = F.col("_hit").isNull()
    rest = (
        keyed.join(lost, "digest", "left_semi")
        .join(unwanted, F.col("doc_id").eqNullSafe(F.col("_gone")), "left")
        .groupBy("digest")
        .agg(
            F.min(F.when(stays, F.col("doc_id"))).alias("keep_id"),
            F.count(F.when(stays, 1)).alias("group_size"),
        )
    )
    sets = rest.select(
        F.lit(SET).alias("kind"), "digest", "keep_id", "group_size", F.lit(None).cast("binary").alias("filter")
    )
    return _in_shards(index.unionByName(sets), _shards_of(index))


def entries(index: DataFrame) -> DataFrame:
    """Live groups of an index: ``(digest, keep_id, group_size)``."""
    return index.where(F.col("kind") == ENTRY).select("digest", "keep_id", "group_size")


def groups_of(keyed: DataFrame) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size)`` of stored ``(doc_id, digest)`` rows."""
    return join_groups(keyed, entries(build(keyed)), "digest", "group_size")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the smallest id."""
    groups = groups_of(digests(docs, id, text))
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    name, own = free_name(docs, "kept_id"), free_name(docs, "kept_digest")
    kept = kept.select(F.col("doc_id").alias(name), F.col("digest").alias(own))
    return docs.join(kept, F.col(id).eqNullSafe(F.col(name)) & (digest_of(text) == F.col(own)), "left_semi")
