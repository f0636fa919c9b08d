"""Repeated passages across documents, found on a compacted de Bruijn graph of words.

A node is a run of ``k - 1`` words, an edge a run of ``k`` words (a window): from the node of its first
words to that of its last ones. Edges that start in two documents or more are repeated; the smallest
document of an edge, and the place where it first starts there, are its source coordinates.

0. *Copies.* Rows of equal texts differ by nothing: the one of the smallest id stands for all in the graph, and
   each other is one span, from its first word to its last, whose source is that row (verified as all spans are).
1. *Marks.* Of the short runs inside a window the one with the least hash is the window's mark; equal
   windows have equal marks, and neighbours mostly share one. Only marks are counted over all documents:
   a window whose mark lies in one document is not repeated, and never becomes a row.
2. *Edges* of the other windows are counted; those of one document go.
3. *Compaction.* Nodes that repeated edges leave or enter in more than one way are branches; a join tells
   each edge whether it starts at one. Edges that follow one another in their source, without a branch
   between, are one path.
4. *Occurrences.* A join gives each repeated window of a document its path and the place on it; windows
   that go along a path are one span.
5. *Verification.* The words of each span and those at its source coordinates must have one SHA-256; the
   job stops if a pair does not, which takes two equal 128-bit names of edges.

Words are runs without white space, compared as they are. A window is repeated if its words also start in
a document with a smaller id; windows are judged on the input, not on what is left.

Nulls: a null text has no words. A row without an id is no source, and keeps all its words. Rows that
repeat an id are rows of their own, and none is smaller than the other. A text is cut as a whole, so a
task needs some forty times the longest one as memory. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelkite.llm.bytehash import hashes, mixed, runs, slices, text_bytes
from labelkite.llm.tables import join_groups
from labelkite.llm.words import SOLID, Words
from labelkite.shared import forget, written

WORDS = 13
MARK = 5  # words of the short runs that marks are taken from: longer ones are rarer, shorter ones make fewer marks
RANGES = 4096  # of one document that are checked with one copy of its text
COPY = 32  # bits of a place that number the word; those above number rows that repeat an id

EDGES = "node long, next long, doc_id long, place long, first boolean"


def _as_words(raw: np.ndarray, borders: np.ndarray) -> Words:
    """Words as they are, without lower-casing."""
    starts, ends = runs(SOLID[raw], borders)
    row = np.searchsorted(borders, starts, "right") - 1
    return Words(raw, starts, ends, row, hashes(raw, starts, ends), len(borders) - 1)


def _at_words(words: Words, k: int) -> np.ndarray:
    """By word: the hash of the run of ``k`` words that starts there; the largest number where none does."""
    out = np.full(len(words.hash) + 1, np.iinfo(np.uint64).max)
    first, found = words.windows(k)
    out[first] = found
    return out


def _window_marks(words: Words, k: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and its mark."""
    first = words.starting(k)
    n = len(words.hash) - k + 1
    if not len(first):
        return first, np.zeros(0, np.uint64)
    runs_at = _at_words(words, short)
    marks = runs_at[:n].copy()
    for j in range(1, k - short + 1):
        np.minimum(marks, runs_at[j : n + j], out=marks)
    return first, marks[first]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def _of_slices(column) -> Iterator[tuple[int, int, Words]]:
    raw, borders = text_bytes(column)
    for a, b in slices(borders):
        yield a, b, _as_words(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])


def _marks(batches: Iterator[pa.RecordBatch], k: int, short: int) -> Iterator[pa.RecordBatch]:
    """``(mark, doc_id)``, each mark of a row once."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, words in _of_slices(batch.column(1)):
            first, marks = _window_marks(words, k, short)
            row = words.row[first]
            new = _changes(row, marks)  # neighbours mostly share a mark
            row, marks = row[new], marks[new]
            order = np.lexsort((marks, row))
            row, marks = row[order], marks[order]
            new = _changes(row, marks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks[new].view(np.int64)), pa.array(ids[a:b][row[new]], pa.int64())], ["mark", "doc_id"]
            )


def _edges(batches: Iterator[pa.RecordBatch], k: int, short: int, counting: bool = True) -> Iterator[pa.RecordBatch]:
    """The windows whose marks lie in several documents: ``(node, next, doc_id, place, first)``.

    ``first`` tells whether an edge starts there first in its row; it is false throughout unless edges are counted.
    """
    for batch in batches:
        ids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for a, b, words in _of_slices(batch.column(2)):
            shared = np.unique(batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            first, marks = _window_marks(words, k, short)
            new = _changes(marks)
            first = first[np.isin(marks[new].view(np.int64), shared)[np.cumsum(new) - 1]]
            nodes = _at_words(words, k - 1)
            node, following, row = nodes[first], nodes[first + 1], words.row[first]
            is_first = np.zeros(len(row), bool)
            if counting:
                names = mixed(node + mixed(following + row.astype(np.uint64)))
                order = np.argsort(names, kind="stable")  # the first of equal ones comes first
                is_first[order[_changes(row[order], node[order], following[order])]] = True
            sizes = words.per_row()
            own = first - (np.cumsum(sizes) - sizes)[row]
            place = ((copies[a:b][row].astype(np.int64) - 1) << COPY) + own
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node.view(np.int64)),
                    pa.array(following.view(np.int64)),
                    pa.array(ids[a:b][row], pa.int64()),
                    pa.array(place),
                    pa.array(is_first),
                ],
                ["node", "next", "doc_id", "place", "first"],
            )


def _copies(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``(doc_id, place, keep, name, windows)`` of the texts that have a window."""
    for batch in batches:
        raw, borders = text_bytes(batch.column(4))
        starts, _ = runs(SOLID[raw], borders)
        windows = np.bincount(np.searchsorted(borders, starts, "right") - 1, minlength=batch.num_rows) - (k - 1)
        columns = [*batch.columns[:4], pa.array(windows, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "keep", "name", "windows"]).filter(pa.array(windows > 0))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ranges of a document's words, joined by one space: ``(doc_id, place, length, digest)``."""
    for batch in batches:
        ids, copies, texts, ranges = (batch.column(i) for i in range(4))
        out: list[tuple] = []
        for i, (doc, copy, wanted) in enumerate(zip(ids.to_pylist(), copies.to_pylist(), ranges.to_pylist())):
            joined = (texts[i].as_py() or "").encode()
            raw = np.frombuffer(joined, np.uint8)
            starts, ends = runs(SOLID[raw], np.array([0, len(raw)]))
            own = copy - 1
            for r in wanted:
                if r["place"] >> COPY == own:
                    at = r["place"] & ((1 << COPY) - 1)
                    part = joined[starts[at] : ends[at + r["length"] - 1]]
                    out.append((doc, r["place"], r["length"], sha256(b" ".join(part.split())).digest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "place", "length", "digest"])


def equal_texts(rows: DataFrame) -> DataFrame:
    """Stored ``(doc_id, name, keep)``: the rows whose text, called ``name``, is that of ``keep``, a smaller id."""
    names = written(rows.where("name is not null").select("doc_id", "name"), "text-names")
    groups = names.groupBy("name").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    groups = written(groups.where("keep < last").select("name", "keep", "n"), "equal-texts")
    found = join_groups(names, groups, "name", "n").where("doc_id > keep").select("doc_id", "name", "keep")
    found = written(found.distinct(), "copies")
    forget(names)
    forget(groups)
    return found


def copy_spans(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """Stored ``(doc_id, place, windows, source, source_place)``: the whole of each copy, at the row that it repeats."""
    place = F.shiftleft((F.col("copy") - 1).cast("long"), COPY)
    sources = texts.where("keep is null and name is not null").groupBy(F.col("doc_id").alias("keep"), "name")
    sources = sources.agg(F.min(place).alias("source_place"))
    copies = texts.where("keep is not null").select("doc_id", place.alias("place"), "keep", "name", "text")
    copies = copies.mapInArrow(lambda batches: _copies(batches, k), "doc_id long, place long, keep long, name string, windows long")
    found = copies.join(sources, ["keep", "name"])
    return written(found.select("doc_id", "place", "windows", F.col("keep").alias("source"), "source_place"), "copy-spans")


def shared_marks(docs: DataFrame, k: int = WORDS, short: int = MARK) -> DataFrame:
    """``(doc_id, marks)``: of each document the marks that other documents have as well."""
    marks = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(
        lambda batches: _marks(batches, k, short), "mark long, doc_id long"
    )
    marks = written(marks, "marks")
    counts = marks.groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = written(counts.where("low < high").select("mark", "n"), "shared-marks")
    own = join_groups(marks, shared.hint("shuffle_hash"), "mark", "n").select("doc_id", "mark")
    own = written(own.groupBy("doc_id").agg(F.collect_list("mark").alias("marks")), "document-marks")
    forget(marks)
    forget(shared)
    return own


def repeated_edges(windows: DataFrame) -> DataFrame:
    """``(node, next, source, place)`` of the windows that start in two documents or more."""
    counts = windows.groupBy("node", "next").agg(
        F.min("doc_id").alias("source"),
        F.max("doc_id").alias("last"),
        F.expr("min_by(place, doc_id) FILTER (WHERE first)").alias("place"),
    )
    return counts.where("source < last").drop("last")


def compacted(edges: DataFrame) -> DataFrame:
    """The stored edges with their path: ``(node, next, source, start, step)``; a path is named by source and start."""
    one, none = F.lit(1).alias("leave"), F.lit(0).alias("enter")
    ends = edges.select("node", one, none).unionByName(edges.select(F.col("next").alias("node"), F.lit(0).alias("leave"), F.lit(1).alias("enter")))
    branches = ends.groupBy("node").agg(F.sum("leave").alias("leave"), F.sum("enter").alias("enter"))
    branches = branches.where("leave > 1 or enter > 1").select("node", F.lit(True).alias("branch"))
    told = edges.join(branches.hint("shuffle_hash"), "node", "left")  # no sort of the edges for it
    along = Window.partitionBy("source").orderBy("place", "node", "next")
    follows = F.col("branch").isNull() & (F.lag("place").over(along) == F.col("place") - 1)
    starts = told.withColumn("follows", F.coalesce(follows, F.lit(False)))
    start = F.max(F.when(~F.col("follows"), F.col("place"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return starts.withColumn("start", start).select("node", "next", "source", "start", (F.col("place") - F.col("start")).alias("step"))


def occurrences(windows: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored ``(doc_id, place, windows, source, source_place)``: spans of windows along a path, in larger documents.

    The stored paths are deleted as soon as they are used.
    """
    found = windows.select("node", "next", "doc_id", "place").join(paths.hint("shuffle_hash"), ["node", "next"]).where("doc_id > source")
    hits = found.select("doc_id", "place", "source", "start", (F.col("place") - F.col("step")).alias("line"))
    hits = written(hits, "hits")  # so that the shuffles of the join and of the spans do not lie side by side
    forget(paths)
    order = Window.partitionBy("doc_id", "source", "start", "line").orderBy("place")
    numbered = hits.withColumn("island", F.col("place") - F.row_number().over(order))
    spans = numbered.groupBy("doc_id", "source", "start", "line", "island").agg(
        F.min("place").alias("place"), F.count("*").alias("windows")
    )
    there = F.col("start") + F.col("place") - F.col("line")
    spans = written(spans.select("doc_id", "place", "windows", "source", there.alias("source_place")), "spans")
    forget(hits)
    return spans


def verified(spans: DataFrame, texts: DataFrame, k: int = WORDS) -> DataFrame:
    """The stored spans; an error where the words at the source coordinates are others."""
    length = (F.col("windows") + k - 1).alias("length")
    own = spans.select("doc_id", "place", length)
    there = spans.select(F.col("source").alias("doc_id"), F.col("source_place").alias("place"), length)
    ranges = written(own.unionByName(there).distinct(), "ranges")
    salts = ranges.groupBy("doc_id").agg(F.ceil(F.count("*") / RANGES).alias("salts"))
    salted = ranges.join(salts, "doc_id").withColumn("salt", F.pmod(F.xxhash64("place", "length"), F.col("salts")))
    lists = salted.groupBy("doc_id", "salt").agg(F.collect_list(F.struct("place", "length")).alias("ranges"))
    digests = written(
        texts.select("doc_id", "copy", "text")
        .join(lists, "doc_id")
        .select("doc_id", "copy", "text", "ranges")
        .mapInArrow(_digests, "doc_id long, place long, length long, digest binary"),
        "range-digests",
    )
    checked = (
        spans.withColumn("length", length)
        .join(digests, ["doc_id", "place", "length"])
        .join(digests.toDF("source", "source_place", "length", "expected"), ["source", "source_place", "length"])
    )
    wrong = F.when(F.col("digest") != F.col("expected"), F.raise_error(F.lit("two runs of words have one name")))
    kept = checked.withColumn("wrong", F.coalesce(wrong.cast("boolean"), F.lit(False))).where("not wrong")
    return written(kept.select("doc_id", "place", "length", "source", "source_place"), "repeated-spans")


def repeated_spans(docs: DataFrame, k: int = WORDS, short: int = MARK, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored texts ``(doc_id, copy, text)`` with an id, and stored spans ``(doc_id, place, length, source, source_place)``.

    A place counts the words of a text from 0; its bits from 32 on are the row's number among those that
    repeat the id, less one, as ``copy`` is.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    rows = rows.withColumn("name", F.md5("text"))
    copies = equal_texts(rows)
    marks = shared_marks(rows.join(copies, ["doc_id", "name"], "left_anti"), k, short)
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy("name")).alias("copy")
    lists = copies.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "keep"))).alias("keeps"))
    dealt = rows.join(marks, "doc_id", "left").join(lists, "doc_id", "left")
    texts = written(dealt.select("doc_id", copy, "text", "name", F.col("keeps")[F.col("name")].alias("keep"), "marks"), "marked-texts")
    forget(marks)
    forget(copies)
    marked = texts.where("marks is not null and keep is null").select("doc_id", "copy", "text", "marks")
    edges = written(repeated_edges(marked.mapInArrow(lambda batches: _edges(batches, k, short), EDGES)), "edges")
    paths = written(compacted(edges), "paths")
    forget(edges)
    windows = marked.mapInArrow(lambda batches: _edges(batches, k, short, counting=False), EDGES)
    spans = occurrences(windows, paths).unionByName(copy_spans(texts, k))
    texts = texts.select("doc_id", "copy", "text")
    return texts, verified(spans, texts, k)


def without_repeats(docs: DataFrame, k: int = WORDS, short: int = MARK, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each document without the words of repeated windows, joined by one space."""
    texts, spans = repeated_spans(docs, k, short, id, text)
    lists = spans.groupBy("doc_id", (F.shiftright("place", COPY) + 1).cast("int").alias("copy")).agg(
        F.collect_list(F.struct(F.col("place").bitwiseAND((1 << COPY) - 1).alias("begin"), "length")).alias("spans")
    )
    whole = texts.join(lists, ["doc_id", "copy"], "left").select("doc_id", "text", "spans")
    unnamed = docs.where(F.col(id).isNull()).select(
        F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast(whole.schema["spans"].dataType).alias("spans")
    )
    return whole.unionByName(unnamed).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
            words = (text or "").encode().split()  # bytes are split at the six signs that end a word here
            n = len(words)
            if spans:
                kept, at = [], 0
                for begin, end in sorted((s["begin"], s["begin"] + s["length"]) for s in spans):
                    kept += words[at:begin]  # nothing, where spans overlap
                    at = max(at, end)
                words = kept + words[at:]
            rows.append((doc, n, n - len(words), b" ".join(words).decode()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.large_string()]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_words", "n_removed", "kept"])
