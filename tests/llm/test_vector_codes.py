import numpy as np
import pytest
from pyspark.sql import functions as F

from labelkite.llm import vector_codes as V

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks by comparing all parts with all entries."""
    kept = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64), y) for i, v, y in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    whole = np.array([r[1] for r in kept])
    codes, books, error = [], [], np.zeros(len(kept), np.int64)
    for x in np.split(whole, parts, 1):
        book = x[:entries].copy()
        for t in range(rounds + 1):
            square = ((x[:, None] - book[None]) ** 2).sum(2)
            own = square.argmin(1)
            if t < rounds:
                for e in set(own.tolist()):
                    mine = x[own == e]
                    book[e] = mine.sum(0) // len(mine)
        codes.append(own)
        books.append(book)
        error += square.min(1)
    return sorted([(r[0], tuple(int(c[n]) for c in codes), int(error[n])) for n, r in enumerate(kept)], key=repr), books


def coded(frame, entries=256, block=V.BLOCK):
    blocks = V.blocks_of(frame, "vec_id", "embedding", "label", block=block)
    books = V.fit(blocks, V.first_codebooks(frame, "vec_id", "embedding", entries=entries))
    out = V.encode(blocks, books).collect()
    return sorted([(r["vec_id"], tuple(r["codes"]), r["error"]) for r in out], key=repr), books.books


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.2, (20, 8))
    found = [(i * 7 % 10007, (centres[rng.integers(20)] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(900)]
    same = [(20_000 + i, [0.25] * 8, None) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [None] * 8, 0), (3, [0.1] * 7 + [nan], 0), (4, [inf] + [0.0] * 7, 0), (5, [-inf] + [0.0] * 7, 1),
           (None, [0.5] * 8, None), (30_000, [0.0] * 8, 1), (30_000, [0.0] * 8, 1), (30_000, [-0.1] * 8, 2)]
    return found + same + odd


@pytest.mark.parametrize("entries,block", [(256, 4096), (16, 100), (1, 64)])
def test_codes_against_brute_force(spark, rows, entries, block):
    frame = spark.createDataFrame(rows, VECTORS).withColumn("codes", F.lit("x")).withColumn("error", F.lit("y")).repartition(3)
    got, books = coded(frame, entries, block)
    want, want_books = plain(rows, entries=entries)
    assert got == want and all((a == b).all() for a, b in zip(books, want_books))


def test_balls_hold_their_points():
    rng = np.random.default_rng(4)
    for n, points in ((1, 1), (17, 3), (500, 500), (300, 40)):
        x = rng.integers(-500, 500, (points, 4))[rng.integers(points, size=n)]
        tree = V.Tree.read(V.build(x).stored())
        assert sorted(tree.order.tolist()) == list(range(n)) and (x[tree.order] == tree.points).all()
        for b, (first, last, left, right) in enumerate(zip(tree.first, tree.last, tree.left, tree.right)):
            own = tree.points[first:last]
            assert (own.sum(0) == tree.sums[b]).all()
            assert np.sqrt(((own - tree.centre[b]) ** 2).sum(1)).max() <= tree.radius[b] + 1e-9
            if left >= 0:
                assert tree.first[left] == first and tree.last[left] == tree.first[right] and tree.last[right] == last


def test_anchors_own_what_is_nearest_to_them():
    x = np.random.default_rng(5).normal(size=(400, 3))
    groups = V._anchors(x)
    assert len(groups) == 20 and sorted(np.concatenate(groups).tolist()) == list(range(400))
    at = [g[-1] for g in groups]  # nearest last: the anchor itself
    nearest = ((x[:, None] - x[at][None]) ** 2).sum(2)
    for k, g in enumerate(groups):
        assert (nearest[g, k] <= nearest[g].min(1) + 1e-12).all()


def test_ties_go_to_the_lower_entry_and_owned_balls_are_not_looked_into():
    book = np.array([[0, 0], [10, 0], [0, 0], [10, 10]])
    points = np.array([[5, 0], [0, 0], [10, 5], [5, 5], [-5, 0]] * 30)
    found = V.Assignment(V.build(points), book, points=True)
    tree = V.build(points)
    assert found.entry[np.argsort(tree.order)][:5].tolist() == [0, 0, 1, 0, 0]
    rng = np.random.default_rng(6)
    apart = np.concatenate([rng.integers(0, 20, (500, 2)) + 1000 * k for k in range(4)])
    owned = V.Assignment(V.build(apart), np.array([[1000 * k + 10] * 2 for k in range(4)]))
    assert owned.looked == 0 and owned.count.tolist() == [500] * 4


def test_large_components_and_errors(spark):
    rows = [(i, [float((-1) ** i * (60_000 + i * 7 % 50)) for _ in range(4)], 1) for i in range(40)]
    got, _ = coded(spark.createDataFrame(rows, VECTORS), entries=8)
    assert got == plain(rows, entries=8)[0]
    for bad in ([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 6, 0)], [(1, [1e30] * 4, 0)]):
        with pytest.raises(Exception, match="length|components"):
            coded(spark.createDataFrame(bad, VECTORS).repartition(1))


def test_label_error_and_nothing(spark, rows):
    frame = spark.createDataFrame(rows, VECTORS)
    blocks = V.blocks_of(frame, "vec_id", "embedding", "label", block=200)
    books = V.fit(blocks, V.first_codebooks(frame, "vec_id", "embedding"))
    out = V.with_label_error(V.encode(blocks, books)).collect()
    sums = {}
    for r in out:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert {(r["label"], r["label_error"]) for r in out} == set(sums.items()) and None in sums
    none = frame.where("vec_id = 1")
    blocks = V.blocks_of(none, "vec_id", "embedding", "label")
    books = V.fit(blocks, V.first_codebooks(none, "vec_id", "embedding"))
    assert not books.books and V.with_label_error(V.encode(blocks, books)).count() == 0
