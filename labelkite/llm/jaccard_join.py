"""Jaccard join of word shingle sets by PartEnum signatures, and the groups that its links make.

Sets are taken by bands of size. Within band ``i`` two sets that reach the similarity differ in at
most ``k`` shingles. The domain of shingles is cut by a hash into ``ceil((k + 1) / 2)`` parts, so one
part has at most one difference; each part is cut into three, and the signatures are the three pairs
of them, so that one pair is untouched: linked sets share a signature. A set has the signatures of its
own band, and those of the next if it is large enough to be linked with a set there.

Pairs of parts with few shingles or none tell nothing and would be shared by unrelated sets. There are a
few parts more than needed, and a set that is not the largest of its band differs in fewer shingles than
the band's bound, so some parts are to spare. If no more parts than that have a thin pair, the set leaves
out all its thin pairs: another part without one is left, and what is untouched there is as thick in the
linked set, which has it too. Sets that may differ in one shingle at most enumerate their subsets instead:
the whole, and all but one; larger sets that may be linked with those have the subsets of such sizes.

Links are found in two rounds. First each signature's smallest and largest set are compared with all
its other sets (stars, not pairs). Then sets that share a signature and are not yet in one component
are compared in blocks inside a task, by a sketch: counts of shingles by hash cell, whose distance is
never above the number of differing shingles. Fewer cells are compared first, then all of them; only pairs
that these cannot tell apart come out, some thousands at a time.
Every link is verified on the full sets of 64-bit hashes of the whole texts. Copies are one set: only
the first row of a set in an Arrow batch carries signatures.

Nulls: a null text has no shingles, as an empty one, and is linked with nothing. A row without an id is
linked with nothing and has no group. Rows that repeat an id are one document and should repeat its
text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm import bytehash
from labelkite.llm.components import FILE_ROWS, components
from labelkite.llm.tables import join_groups, only
from labelkite.llm.words import SOLID, Words
from labelkite.shared import written

WORDS = 3
SIMILARITY = Fraction(90, 100)
BAND = Fraction(5, 4)  # by which the sizes of a band grow, at least
SUBPARTS = 3
SPARE = Fraction(2, 100)  # parts more than needed, and one
THICK = 3  # shingles of a pair of parts that tells enough
SLICE_BYTES = 1 << 19  # of texts at a time; their hashes take some fifty times as much
MEMBERS = 256  # sets that are compared with one copy of a star's centre
BLOCK = 512  # sketches of a signature that are compared with one block of others
SKETCH, SMALL = 256, 64  # cells of a sketch, and of the coarser one that is compared first
OUT = 1 << 16  # pairs that a task gathers before they go on
CELLS = 1 << 24  # of a bitmap of keys that are needed at all: two megabytes, however many keys there are

_SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(raw: np.ndarray, borders: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all rows, ascending in each row, and the rows' borders."""
    words = Words.of(raw, borders, SOLID)
    first, hashes = words.windows(k)
    rows, parts = [words.row[first]], [hashes]
    sizes = words.per_row()
    for n in range(1, k):  # texts of fewer words: their whole sequence
        first, hashes = words.windows(n)
        short = sizes[words.row[first]] == n
        rows.append(words.row[first[short]])
        parts.append(hashes[short])
    row, h = np.concatenate(rows), np.concatenate(parts)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    counts = np.bincount(row[new], minlength=len(borders) - 1)
    return h[new], np.concatenate([[0], np.cumsum(counts)])


class Bands:
    """Size bands from 1 to ``largest``: first size, bound of differences and parts of each."""

    def __init__(self, largest: int, similarity: Fraction = SIMILARITY):
        # Each start is at least the one before by the similarity, so that links span two bands at most.
        growth = max(BAND, 1 / similarity)
        starts = [1]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, ceil(starts[-1] * growth)))
        starts.append(max(starts[-1] + 1, ceil(starts[-1] * growth)))
        self.share = (1 - similarity) / (1 + similarity)
        self.starts = np.array(starts, np.int64)
        differences = [int(self.share * 2 * (b - 1)) for b in starts[1:]]
        # Sets without differences are equal, which needs no signature.
        needed = [(d + 2) // 2 if d else 0 for d in differences]
        self.parts = np.array([n + ceil(n * SPARE) + 1 if n else 0 for n in needed], np.int64)
        self.smallest_partner = np.array([-(-similarity.numerator * s // similarity.denominator) for s in starts])
        self.similarity = similarity
        # Sizes of sets of which a linked set lacks one shingle at most, and of those that may be linked with these.
        self.small = int(2 / (1 - similarity)) - (2 % (1 - similarity) == 0)
        self.near_small = int(self.small / similarity)

    def spare(self, sizes: np.ndarray, instance: np.ndarray) -> np.ndarray:
        """Parts that a set may leave out: one without two differences is left with every linked set."""
        largest = np.minimum(sizes * self.similarity.denominator // self.similarity.numerator, self.starts[instance + 1] - 1)
        differences = self.share.numerator * (sizes + largest) // self.share.denominator
        return self.parts[instance] - differences // 2 - 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1


def signatures(h: np.ndarray, borders: np.ndarray, similarity: Fraction = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of the rows' sets, and the row of each."""
    sizes = np.diff(borders)
    bands = Bands(int(sizes.max(initial=1)), similarity)
    band = np.where(sizes > 0, bands.of(np.maximum(sizes, 1)), 0)
    place = bytehash.mixed(h ^ _SALTS[0])
    value = bytehash.mixed(h ^ _SALTS[1])
    found, rows = _subsets(value, borders, bands)
    for step in (0, 1):
        instance = band + step
        parts = np.where(sizes > bands.small, bands.parts[instance], 0)
        if step:
            parts[sizes < bands.smallest_partner[instance]] = 0
        first = np.cumsum(parts) - parts  # first part of each row
        of_row = np.repeat(np.arange(len(sizes)), sizes)
        used = parts[of_row] > 0
        cells = (parts[of_row[used]] * SUBPARTS).astype(np.uint64)
        cell = first[of_row[used]] * SUBPARTS + (place[used] % cells).astype(np.int64)
        sums = np.zeros(int(parts.sum()) * SUBPARTS, np.uint64)
        np.add.at(sums, cell, value[used])
        sums = sums.reshape(-1, SUBPARTS)
        row = np.repeat(np.arange(len(sizes)), parts)
        part = np.arange(len(row)) - first[row]
        tag = (instance[row].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) * np.uint64(SUBPARTS)
        left_out = np.arange(SUBPARTS, dtype=np.uint64)
        pairs = sums.sum(1, dtype=np.uint64)[:, None] - sums
        made = bytehash.mixed(pairs + bytehash.mixed((tag[:, None] + left_out) ^ _SALTS[2]))
        held = np.bincount(cell, minlength=sums.size).reshape(-1, SUBPARTS)
        held = held.sum(1)[:, None] - held  # shingles of each pair
        least = np.zeros(len(sizes), np.int64)
        spare = bands.spare(sizes, instance)
        for t in range(1, THICK + 1):
            thin_parts = np.bincount(row, (held < t).any(1), len(sizes))
            least[thin_parts <= spare] = t
        kept = held >= least[row][:, None]
        found.append(made[kept])
        rows.append(np.repeat(row, kept.sum(1)))
    return np.concatenate(found), np.concatenate(rows)


def _subsets(value: np.ndarray, borders: np.ndarray, bands: Bands) -> tuple[list, list]:
    """Signatures of small sets, and of those that may be linked with them: subsets of a small set's size."""
    found, rows = [], []
    sizes = np.diff(borders)
    similarity = bands.similarity
    for i in np.flatnonzero((sizes > 0) & (sizes <= bands.near_small)).tolist():
        own = value[borders[i] : borders[i + 1]]
        n = len(own)
        for k in range(n - n * (similarity.denominator - similarity.numerator) // similarity.denominator, n + 1):
            if k <= bands.small:
                gone = [sum(map(int, c)) for c in combinations(own, n - k)]
                whole = sum(map(int, own))
                found += [(whole - x + k * int(_SALTS[2])) % (1 << 64) for x in gone]
                rows += [i] * len(gone)
    return [bytehash.mixed(np.array(found, np.uint64))], [np.array(rows, np.int64)]


def _digests(h: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each row's set."""
    out = np.zeros((len(borders) - 1, 2), np.uint64)
    for j in (0, 1):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(bytehash.mixed(h ^ _SALTS[j + 1])))
        out[:, j] = bytehash.mixed(sums[borders[1:]] - sums[borders[:-1]] + np.diff(borders).astype(np.uint64))
    return out


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order].view(np.int64)))


def _sketches(h: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Shingles of each row by hash cell, 255 at most."""
    n = len(borders) - 1
    cell = np.repeat(np.arange(n), np.diff(borders)) * SKETCH + (bytehash.mixed(h ^ _SALTS[2]) % SKETCH).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=n * SKETCH), 255).astype(np.uint8).reshape(n, SKETCH)


def _sets_of(column, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By slices of rows ``a:b``: the hashes of their shingles, and the borders of the rows."""
    raw, borders = bytehash.text_bytes(column)
    for a, b in bytehash.slices(borders, SLICE_BYTES):
        yield a, b, *shingle_sets(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a], words)


def _described(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, h, ends in _sets_of(batch.column(1), words):
            keys = [d.tobytes() for d in _digests(h, ends)]
            sketches = _sketches(h, ends)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([x.tobytes() for x in sketches], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )


def _signed(
    batches: Iterator[pa.RecordBatch], words: int, similarity: Fraction, wanted: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """A row for each signature whose cell is in the bitmap ``wanted``; for all without one."""
    for batch in batches:
        seen: set[bytes] = set()
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, h, ends in _sets_of(batch.column(1), words):
            carries = np.zeros(b - a, bool)
            for i, key in enumerate(map(bytes, _digests(h, ends))):
                carries[i] = key not in seen
                seen.add(key)
            found, row = signatures(h, ends, similarity)
            mine = carries[row]
            if wanted is not None:
                mine &= _marked(wanted, found & np.uint64(CELLS - 1))
            row = row[mine]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found[mine].view(np.int64)),
                    pa.array(ids[a:b][row], pa.int64()),
                    pa.array(np.diff(ends)[row], pa.int64()),
                ],
                ["signature", "doc_id", "n_shingles"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch], words: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of documents whose cell is in the bitmap."""
    for batch in batches:
        cell = batch.column(2).to_numpy(zero_copy_only=False)
        chosen = batch.filter(pa.array(_marked(wanted, cell)))
        for a, b, h, ends in _sets_of(chosen.column(1), words):
            sets = [h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [chosen.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "shingles"]
            )


def _marked(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    cell = cell.astype(np.int64)
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(cells: DataFrame):
    """Broadcast bitmap of the one column of ``cells``, numbers below ``CELLS``."""
    cell = F.col(cells.columns[0]) + 1  # the functions number their bits from 1
    parts = (
        cells.groupBy(F.bitmap_bucket_number(cell).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
        .collect()
    )
    bitmap = np.zeros(CELLS // 8, np.uint8)
    for r in parts:
        bits = np.frombuffer(r["bits"], np.uint8)
        bitmap[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    return cells.sparkSession.sparkContext.broadcast(bitmap)


def _cell(id: str) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(CELLS))


def _compared(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows come by centre and salt, the centre's own set first; links come out."""
    above, below = similarity.numerator, similarity.denominator
    centre, own = None, None
    for batch in batches:
        a, b = [], []
        sets = batch.column(3).cast(pa.large_binary())
        _, ends, data = sets.buffers()
        ends = np.frombuffer(ends, np.int64)[sets.offset :]
        for i, (x, salt, member) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)])):
            shingles = np.frombuffer(data, np.uint64, (ends[i + 1] - ends[i]) // 8, ends[i])
            if member is None:
                centre, own = (x, salt), shingles.copy()
            elif centre == (x, salt):
                spot = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
                common = int(np.count_nonzero(own[spot] == shingles))
                if below * common >= above * (len(own) + len(shingles) - common):
                    a.append(x)
                    b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_pairs(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows come by signature and pair of blocks; pairs of sets that the sketch cannot tell apart come out.

    A task holds one pair of blocks and at most some ``OUT`` pairs more than that makes.
    """

    def compared(block: list) -> Iterator[np.ndarray]:
        docs, own, parts, n, sketches = zip(*block)
        docs, own, parts, n = (np.array(x) for x in (docs, own, parts, n))
        sketch = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(n), SKETCH).astype(np.int16)
        small = sketch.reshape(len(n), SMALL, SKETCH // SMALL).sum(2, dtype=np.int16)
        for i in range(len(n) - 1):
            rest = np.arange(i + 1, len(n))
            rest = rest[(parts[rest] != parts[i]) & ((own[rest] != own[i]) | one)]
            fewer, more = np.minimum(n[i], n[rest]), np.maximum(n[i], n[rest])
            rest = rest[fewer * similarity.denominator >= more * similarity.numerator]
            for cells in (small, sketch):  # few cells tell most sets apart
                differ = np.abs(cells[rest] - cells[i]).sum(1, dtype=np.int64)
                limit = (similarity.denominator - similarity.numerator) * (n[i] + n[rest])
                rest = rest[differ * (similarity.denominator + similarity.numerator) <= limit]
            if len(rest):
                near = docs[rest]
                yield np.stack([np.minimum(near, docs[i]), np.maximum(near, docs[i])])

    def blocks() -> Iterator[list]:
        nonlocal one
        now, block = None, []
        for batch in batches:
            for signature, low, high, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if now != (signature, low, high):
                    yield block
                    now, block, one = (signature, low, high), [], low == high
                block.append(row)
        yield block

    one, found, n = True, [], 0
    for block in blocks():
        for pairs in compared(block) if len(block) > 1 else ():
            found.append(pairs)
            n += pairs.shape[1]
            if n >= OUT:
                yield _distinct_pairs(found)
                found, n = [], 0
    if found:
        yield _distinct_pairs(found)


def _distinct_pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    """Neighbouring signatures have many pairs in common."""
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])


def _still_apart(members: DataFrame, part_of: DataFrame, found: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs that share a signature, lie in two components and may be linked.

    Many signatures have the same sets: one of them is enough, and two hashes of its sets tell which are
    the same. A signature's sets are cut into blocks; each block meets each block in a task of its own.
    """
    named = members.join(part_of, F.col("doc_id") == F.col("vertex"), "left")
    named = named.select("signature", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    named = written(named, "named-members")
    own_hash = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"sets{i}") for i in (1, 2)]
    parts = named.groupBy("signature").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), *own_hash
    )
    distinct = parts.where("x < y").groupBy("sets1", "sets2", "n").agg(F.min("signature").alias("signature"))
    open_signatures = distinct.select("signature", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    apart = named.join(open_signatures, "signature").join(found.select("doc_id", "sketch"), "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    paired = apart.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    dealt = paired.select("signature", low, high, "doc_id", "own", "component", "n_shingles", "sketch")
    dealt = dealt.repartition("signature", "low", "high").sortWithinPartitions("signature", "low", "high")
    return dealt.mapInArrow(lambda batches: _block_pairs(batches, similarity), "a long, b long").distinct()


def verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The stored pairs ``(a, b)`` whose sets reach the similarity, as a stored table.

    Sets are made from the texts once more, only for the documents of pairs. A centre with many
    members has them dealt out to several tasks, 256 or so to each.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    wanted = _bitmap(ids.select(_cell("doc_id")))
    sets = rows.select("doc_id", "text", _cell("doc_id").alias("cell")).mapInArrow(
        lambda batches: _set_rows(batches, words, wanted.value), "doc_id long, shingles binary"
    )
    sets = written(only(sets, ids.distinct(), "doc_id"), "shingle-sets")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / MEMBERS).alias("salts"))
    files = -(-pairs.count() // MEMBERS)
    sizes = written(sizes, "centres", files=files)
    salted = join_groups(pairs, sizes, "a", "n").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    members = salted.join(sets, F.col("b") == F.col("doc_id")).select("a", "salt", "b", "shingles")
    centres = (
        sizes.join(sets, F.col("a") == F.col("doc_id"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        .select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    )
    dealt = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    links = dealt.mapInArrow(lambda batches: _compared(batches, similarity), "a long, b long")
    return written(links, "verified", files=files)


def _pairs(members: DataFrame, x: str, y: str) -> DataFrame:
    return members.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b")


def _possible(pairs: DataFrame, found: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs that sizes and sketches allow to be linked."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, below = similarity.numerator, similarity.denominator
        for batch in batches:
            m, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            x, y = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
                for i in (4, 5)
            )
            differ = np.abs(x - y).sum(1, dtype=np.int64)
            yes = (np.minimum(m, n) * below >= np.maximum(m, n) * above) & (
                differ * (below + above) <= (below - above) * (m + n)
            )
            yield batch.select([0, 1]).filter(pa.array(yes))

    described = found.select("doc_id", "n_shingles", "sketch")
    both = pairs.join(described.toDF("a", "m", "x"), "a").join(described.toDF("b", "n", "y"), "b")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(kept, "a long, b long")


def similar_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: Fraction = SIMILARITY,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest id that links lead to.

    The texts are read once for digests and sketches, twice for signatures (all of them to count
    them, then only shared ones) and once or twice for the sets to be compared, so that neither sets
    nor signatures are stored for documents that have no partner.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(
        rows.mapInArrow(
            lambda batches: _described(batches, words),
            "doc_id long, n_shingles long, digest binary, sketch binary",
        ),
        "described",
    )
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = found.where(linkable).groupBy("digest")
    classes = written(classes.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")), "classes")

    def signed(wanted=None) -> DataFrame:
        return rows.where("doc_id IS NOT NULL").mapInArrow(
            lambda batches: _signed(batches, words, similarity, wanted and wanted.value),
            "signature long, doc_id long, n_shingles long",
        )

    # Most signatures have one set only; the others' rows are made once more.
    ends = signed().groupBy("signature").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")
    )
    shared = written(ends.where("n > 1"), "shared-signatures")
    larger = shared.where("n > 2").drop("n")
    wanted = _bitmap(larger.select(F.col("signature").bitwiseAND(F.lit(CELLS - 1))))
    members = written(signed(wanted).join(larger, "signature"), "members")
    stars = (
        _pairs(shared, "low", "high")
        .unionByName(_pairs(members, "low", "doc_id"))
        .unionByName(_pairs(members, "doc_id", "high"))
        .distinct()
    )
    stars = written(_possible(stars, found, similarity), "stars")
    # One centre for each document first: the others are compared only if that leaves them apart.
    first = written(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs", files=-(-stars.count() // FILE_ROWS))
    links = verified(first, rows, words, similarity)
    part_of = written(components(_with_copies(links, found, classes)), "parts")

    other = _apart(stars.join(first, ["a", "b"], "left_anti"), part_of)
    more = _still_apart(members.drop("low", "high"), part_of, found, similarity)
    more = written(more.unionByName(other).distinct().join(first, ["a", "b"], "left_anti"), "more-pairs")
    if not more.isEmpty():
        links = links.unionByName(verified(more, rows, words, similarity))
        part_of = components(_with_copies(links, found, classes))

    first = classes.join(part_of, F.col("first_id") == F.col("vertex"), "left").select(
        "digest", "size", F.coalesce("component", "first_id").alias("component_id")
    )
    first = written(first, "components")
    narrow = found.select("doc_id", "n_shingles", "digest")
    full = join_groups(narrow.where(linkable), first, "digest", "size")
    alone = narrow.where(~linkable).withColumn("component_id", F.col("doc_id"))
    return full.unionByName(alone, allowMissingColumns=True).select("doc_id", "n_shingles", "component_id")


def _apart(pairs: DataFrame, part_of: DataFrame) -> DataFrame:
    """The pairs whose documents lie in two components."""
    both = pairs.join(part_of.toDF("a", "x"), "a", "left").join(part_of.toDF("b", "y"), "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _with_copies(links: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """The links, and one from each linked document to the first with an equal set."""
    ends = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).distinct()
    equal = found.select("doc_id", "digest").join(ends, "doc_id").join(classes, "digest")
    equal = equal.where("doc_id != first_id").select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))
    return links.unionByName(equal)


def first_of_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: Fraction = SIMILARITY,
) -> DataFrame:
    """The documents that stay, with all their columns: of each group the smallest id; all without an id."""
    groups = similar_groups(docs, id, text, words, similarity)
    return only(docs, groups.where("doc_id <=> component_id").select("doc_id"), id)
