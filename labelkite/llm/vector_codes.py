"""Product codes of vectors, with exact clustering on metric trees.

A vector's components become integers; it is cut into equal parts, and each part is coded by the nearest
entry of its codebook. Codebooks start as the parts of the first vectors and are moved to the mean of
their parts a fixed number of times.

The vectors are dealt into blocks where they are read, without a shuffle. For each block and part a tree
of balls is built once, from the middle: anchors (Moore, 2000) take the points nearest to them until
there are about the square root of their number; pairs of anchors that fit into the smallest ball are
joined up to the root, and each anchor's points are divided in the same way down to the leaves. A ball
keeps the number and sum of its points. In a round the codebooks, which have a fixed size, go to all
tasks. A ball hands its list of candidate entries to the balls inside it, without those that are farther
than another for every point of it; a ball with one candidate left is wholly owned and gives its number
and sum as they are, and only leaves that are still contested look at points. Sums by part and entry are
aggregated; the driver gets one row for each entry.

All sums, counts and distances are of integers and exact, so blocks and their order change nothing. Ties
go to the entry with the lower index.

Nulls: rows without a vector, or with a null or non-finite component, are dropped. A null id comes last
when the first vectors are chosen. Ids may repeat: each row has its code; among equal ids the smaller
components are first. An empty table gives an empty result. Vectors of different lengths, of a length
that the parts do not divide, or with components above the stated bound raise an error. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.tables import join_groups
from labelkite.shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 4096  # vectors of a block
LEAF = 16  # points that are not divided further
MOST = 1 << 26  # of an integer component: squared distances stay below 2**63


@dataclass
class Tree:
    """Points in the order of the leaves; balls as ranges of points, each before those inside it."""

    order: np.ndarray  # row of each point
    points: np.ndarray  # int64
    first: np.ndarray  # of each ball: its points, and its two halves (-1 in a leaf)
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    FIELDS = ("order", "points", "first", "last", "left", "right", "centre", "radius", "sums")

    def stored(self) -> bytes:
        """All arrays one after the other; the widths follow from three numbers before them."""
        head = np.array([len(self.order), len(self.first), self.points.shape[1]], np.int64)
        return b"".join([head.tobytes(), *[np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS]])

    @classmethod
    def read(cls, data: bytes) -> "Tree":
        n, balls, width = np.frombuffer(data, np.int64, 3)
        sizes = {"order": (n,), "points": (n, width), "centre": (balls, width), "sums": (balls, width)}
        at, found = 24, []
        for f in cls.FIELDS:
            shape = sizes.get(f, (balls,))
            kind = np.float64 if f in ("centre", "radius") else np.int64
            found.append(np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape))
            at += found[-1].nbytes
        return cls(*found)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of ``a`` to one point."""
    return np.sqrt(((a - b) ** 2).sum(1))


def _anchors(points: np.ndarray) -> list[np.ndarray]:
    """The points of about ``sqrt(n)`` anchors: each point is with the nearest one."""
    n = len(points)
    wanted = math.isqrt(n - 1) + 1
    at = [0]  # the anchors' points
    near = _distances(points, points[0])
    owned = [np.argsort(-near, kind="stable")]  # far ones first
    far = [near[owned[0]]]
    while len(at) < wanted:
        widest = max(range(len(at)), key=lambda i: far[i][0])
        if far[widest][0] == 0:
            break  # all points lie on anchors
        new = int(owned[widest][0])
        mine, mine_far = [], []
        between = _distances(points[at], points[new])
        for i in np.flatnonzero(between / 2 < [f[0] for f in far]).tolist():
            # A point nearer to its anchor than half the way to the new one stays.
            some = int(np.searchsorted(-far[i], -between[i] / 2, "right"))
            those = owned[i][:some]
            there = _distances(points[those], points[new])
            gone = there < far[i][:some]
            if gone.any():
                mine.append(those[gone])
                mine_far.append(there[gone])
                kept = np.ones(len(owned[i]), bool)
                kept[:some] = ~gone
                owned[i], far[i] = owned[i][kept], far[i][kept]
        mine, mine_far = np.concatenate(mine), np.concatenate(mine_far)
        order = np.argsort(-mine_far, kind="stable")
        at.append(new)
        owned.append(mine[order])
        far.append(mine_far[order])
    return owned


def build(points: np.ndarray) -> Tree:
    """The tree of balls over integer points (one row at least)."""
    exact = points.astype(np.float64)
    halves: dict[int, tuple] = {}  # number of a ball that is no leaf: its two balls
    members: list[np.ndarray] = []

    def divide(rows: np.ndarray) -> int:
        groups = _anchors(exact[rows]) if len(rows) > LEAF else [np.arange(len(rows))]
        if len(groups) == 1:
            members.append(rows)
            return len(members) - 1
        return join([divide(rows[g]) for g in groups])

    def join(balls: list[int]) -> int:
        """Join the two balls that fit into the smallest one, until one is left."""
        middle = {b: exact[members[b]].mean(0) for b in balls}
        wide = {b: _distances(exact[members[b]], middle[b]).max() for b in balls}

        def pairs(b: int, others: list[int]) -> Iterator[tuple]:
            if others:
                apart = _distances(np.stack([middle[o] for o in others]), middle[b])
                size = np.maximum((apart + wide[b] + [wide[o] for o in others]) / 2, wide[b])
                yield from zip(size.tolist(), [b] * len(others), others)

        heap = [p for i, b in enumerate(balls) for p in pairs(b, balls[:i])]
        heapq.heapify(heap)
        alive = set(balls)
        while len(alive) > 1:
            _, a, b = heapq.heappop(heap)
            if a in alive and b in alive:
                alive -= {a, b}
                members.append(np.concatenate([members[a], members[b]]))
                new = len(members) - 1
                halves[new] = a, b
                middle[new] = exact[members[new]].mean(0)
                wide[new] = _distances(exact[members[new]], middle[new]).max()
                for p in pairs(new, sorted(alive)):
                    heapq.heappush(heap, p)
                alive.add(new)
        return alive.pop()

    root = divide(np.arange(len(points)))
    order: list[np.ndarray] = []
    first, last, left, right, old = [], [], [], [], []
    open_balls, n = [(root, -1, 0)], 0
    while open_balls:
        ball, parent, side = open_balls.pop()
        number = len(first)
        if parent >= 0:
            (left, right)[side][parent] = number
        first.append(n)
        last.append(n + len(members[ball]))
        left.append(-1)
        right.append(-1)
        old.append(ball)
        if ball in halves:
            a, b = halves[ball]
            open_balls += [(b, number, 1), (a, number, 0)]
        else:
            order.append(members[ball])
            n += len(members[ball])
    rows = np.concatenate(order)
    moved = points[rows]
    sums = np.stack([moved[a:b].sum(0) for a, b in zip(first, last)])
    centre = sums / (np.array(last) - first)[:, None]
    radius = np.array([_distances(moved[a:b], c).max() for a, b, c in zip(first, last, centre)])
    arrays = (np.array(x, np.int64) for x in (first, last, left, right))
    return Tree(rows.astype(np.int64), moved, *arrays, centre, radius, sums)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if points.shape[1] * (2 * most) ** 2 < 1 << 52:  # exact as floating-point numbers, whose products are fast
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        out += (points[:, j, None] - entries[None, :, j]) ** 2
    return out


class Assignment:
    """Entries for all points of a tree: what each owns, or the entry and squared distance of each point."""

    def __init__(self, tree: Tree, book: np.ndarray, points: bool = False):
        self.tree, self.book = tree, book
        self.exact = book.astype(np.float64)
        self.between = np.sqrt(((self.exact[:, None] - self.exact[None]) ** 2).sum(2))
        self.count = np.zeros(len(book), np.int64)
        self.sums = np.zeros(book.shape, np.int64)
        self.entry = np.zeros(len(tree.order), np.int64) if points else None
        self.error = np.zeros(len(tree.order), np.int64) if points else None
        self.looked = 0  # points that were compared with entries
        self._descend()

    def _candidates(self, ball: int, entries: np.ndarray) -> np.ndarray:
        """The entries that may be nearest to a point of the ball.

        The difference of two squared distances is linear in the point: over a ball it changes by twice the
        radius times the distance of the entries. Rounding is allowed for, so that none is lost; what is
        left out is farther, not equal.
        """
        centre, radius = self.tree.centre[ball], self.tree.radius[ball]
        square = ((self.exact[entries] - centre) ** 2).sum(1)
        near = int(square.argmin())
        slack = 1e-6 + 1e-9 * (square + square[near])
        reach = 2 * radius * self.between[entries[near], entries] * (1 + 1e-9)
        return entries[square - square[near] <= reach + slack]

    def _descend(self) -> None:
        t = self.tree
        balls = [(0, np.arange(len(self.book)))]
        while balls:
            ball, entries = balls.pop()
            if len(entries) > 1:
                entries = self._candidates(ball, entries)
            a, b = t.first[ball], t.last[ball]
            if len(entries) == 1:
                only = entries[0]
                self.count[only] += b - a
                self.sums[only] += t.sums[ball]
                if self.entry is not None:
                    self.entry[a:b] = only
                    self.error[a:b] = ((t.points[a:b] - self.book[only]) ** 2).sum(1)
            elif t.left[ball] >= 0:
                balls += [(int(t.left[ball]), entries), (int(t.right[ball]), entries)]
            else:
                self._look(a, b, entries)

    def _look(self, a: int, b: int, entries: np.ndarray) -> None:
        points = self.tree.points[a:b]
        self.looked += b - a
        square = _squares(points, self.book[entries])
        best = square.argmin(1)  # entries ascend, so the first of equal ones has the lower index
        own = entries[best]
        np.add.at(self.count, own, 1)
        np.add.at(self.sums, own, points)
        if self.entry is not None:
            self.entry[a:b] = own
            self.error[a:b] = square[np.arange(b - a), best]


def integers(vectors: list, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer components of the vectors that have only finite ones, and which those are."""
    sound = np.array([v is not None and all(x is not None and math.isfinite(x) for x in v) for v in vectors], bool)
    kept = [vectors[i] for i in np.flatnonzero(sound).tolist()]
    if len({len(v) for v in kept}) > 1:
        raise ValueError("vectors of different lengths")
    if not kept:
        return np.zeros((0, 0), np.int64), sound
    whole = np.floor(np.array(kept, np.float64) * scale)
    if np.abs(whole).max(initial=0) > MOST:
        raise ValueError(f"components above {MOST} / {scale}")
    return whole.astype(np.int64), sound


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, scale: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks ``(ids, labels, trees)``: a tree for each part."""
    held: list[tuple] = []
    n = 0

    def closed(size: int) -> pa.RecordBatch:
        nonlocal held, n
        ids, labels = (pa.chunked_array([h[i] for h in held]).combine_chunks() for i in (0, 1))
        points = np.concatenate([h[2] for h in held])
        width = points.shape[1]
        if width % parts:
            raise ValueError(f"vectors of length {width} cannot be cut into {parts} parts")
        step = width // parts
        trees = [build(points[:size, p * step : (p + 1) * step]).stored() for p in range(parts)]
        one = pa.array([0, size], pa.int32())
        done = pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(one, ids[:size]),
                pa.ListArray.from_arrays(one, labels[:size]),
                pa.array([trees], pa.list_(pa.binary())),
            ],
            ["ids", "labels", "trees"],
        )
        held, n = ([(ids[size:], labels[size:], points[size:])] if n > size else []), n - size
        return done

    for batch in batches:
        points, sound = integers(batch.column(2).to_pylist(), scale)
        if len(points):
            chosen = pa.array(sound)
            held.append((batch.column(0).filter(chosen), batch.column(1).filter(chosen), points))
            n += len(points)
        while n >= block:
            yield closed(block)
    if n:
        yield closed(n)


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``(part, entry, n, sums)`` over all blocks of a task."""
    count = [np.zeros(len(b), np.int64) for b in books]
    sums = [np.zeros(b.shape, np.int64) for b in books]
    for batch in batches:
        for trees in batch.column(0).to_pylist():
            for p, data in enumerate(trees):
                found = Assignment(Tree.read(data), books[p])
                count[p] += found.count
                sums[p] += found.sums
    rows = [(p, e, int(count[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist()]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    columns = zip(*rows) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "entry", "n", "sums"])


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each vector: ``(vec_id, label, codes, error)``."""
    for batch in batches:
        for i, trees in enumerate(batch.column(2).to_pylist()):
            ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
            codes = np.zeros((len(ids), len(trees)), np.int64)
            error = np.zeros(len(ids), np.int64)
            for p, data in enumerate(trees):
                tree = Tree.read(data)
                found = Assignment(tree, books[p], points=True)
                codes[tree.order, p] = found.entry
                error[tree.order] += found.error
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(trees), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(error)], ["vec_id", "label", "codes", "error"])


@dataclass
class Codebooks:
    books: list[np.ndarray]  # of each part: entries by components

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, as decimal numbers with commas between."""
        return hashlib.sha256(",".join([str(x) for b in self.books for x in b.ravel().tolist()]).encode()).hexdigest()


def blocks_of(vectors: DataFrame, id: str, vector: str, label: str | None, parts: int = PARTS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Stored blocks ``(ids, labels, trees)`` of all sound vectors."""
    name = F.col(label) if label else F.lit(None).cast("int")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), name.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)["label"]
    schema = f"ids array<bigint>, labels array<{kind}>, trees array<binary>"
    return written(rows.mapInArrow(lambda b: _blocks(b, parts, scale, block), schema), "vector-blocks")


def first_codebooks(vectors: DataFrame, id: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """The parts of the sound vectors with the smallest ids."""
    values = F.col(vector).cast("array<double>")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(values.isNotNull() & sound).select(F.col(id).cast("long").alias("vec_id"), values.alias("v"))
    chosen = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    whole, _ = integers([r["v"] for r in chosen], scale)
    if not len(whole):
        return Codebooks([])
    return Codebooks([np.ascontiguousarray(x) for x in np.split(whole, parts, 1)])


def fit(blocks: DataFrame, start: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after some rounds of assigning all parts and moving each entry to their mean, rounded down."""
    books = start.books
    trees = blocks.select("trees")
    for _ in range(rounds if books else 0):
        width = books[0].shape[1]
        now = books
        found = trees.mapInArrow(lambda b, now=now: _sums(b, now), "part int, entry int, n long, sums array<bigint>")
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        books = [b.copy() for b in books]
        for r in total.collect():  # one row for each entry at most
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return Codebooks(books)


def encode(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, codes, error)`` of every vector: its entries by part, and the summed squared distance."""
    kind = dict(blocks.dtypes)["labels"].removeprefix("array<").removesuffix(">")
    return blocks.mapInArrow(lambda b: _coded(b, books.books), f"vec_id long, label {kind}, codes array<bigint>, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Stored codes with ``label_error``, the error summed over the rows of a label; nulls are one label."""
    rows = written(coded.withColumn("key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))), "codes")
    sums = written(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return join_groups(rows, sums, "key", "n").drop("key", "n")
