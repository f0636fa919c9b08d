import random

import pytest

from labelkite.operators import tree

SCHEMA = "id long, a double, b long, s string, class string"
CLASSES = ["x", "y", "z"]


def some_rows(seed, n):
    """Classes that follow from numbers and strings, with noise, gaps and repeats."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, s = rnd.choice([None, *[k / 2 for k in range(12)]]), rnd.randrange(6), rnd.choice([None, "p", "q", "r"])
        label = "x" if (a or 0) > 2.5 else "y" if s == "q" else "z"
        rows.append((i, a, b, s, rnd.choice(CLASSES) if rnd.random() < 0.15 else label))
    return rows


def impurity(rows):
    return len(rows) - sum(sum(r[-1] == c for r in rows) ** 2 for c in CLASSES) / len(rows) if rows else 0.0


def most(rows):
    return min(CLASSES, key=lambda c: (-sum(r[-1] == c for r in rows), c))


def grow(rows, depth, min_records=2):
    """The same tree by recursion: ``(label, column, edge, children)``."""
    label = most(rows)
    if depth == 0 or impurity(rows) == 0 or len(rows) < 2 * min_records:
        return label, None, None, {}
    best = None
    for c in (1, 2, 3):
        known = [r for r in rows if r[c] is not None]
        values = sorted({r[c] for r in known})
        if c < 3:
            splits = [((v + w) / 2, [[r for r in known if r[c] <= v], [r for r in known if r[c] > v]]) for v, w in zip(values, values[1:])]
            splits = [(e, g) for e, g in splits if min(map(len, g)) >= min_records]
        else:
            groups = [[r for r in known if r[c] == v] for v in values]
            splits = [(None, groups)] if sum(len(g) >= min_records for g in groups) > 1 else []
        for edge, groups in splits:
            gain = round(impurity(known) - sum(map(impurity, groups)), tree.DIGITS)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, c, edge, groups
    if best is None:
        return label, None, None, {}
    _, c, edge, groups = best
    keys = ["low", "high"] if edge is not None else [g[0][c] for g in groups]
    return label, c, edge, {k: grow(g, depth - 1) for k, g in zip(keys, groups)}


def classify(node, row):
    label, c, edge, children = node
    if c is None or row[c] is None:
        return label
    key = row[c] if edge is None else "low" if row[c] <= edge else "high"
    return classify(children[key], row) if key in children else label


def cut_back(node, rows):
    """Reduced-error pruning; the node and what it gets wrong."""
    label, c, edge, children = node
    wrong = sum(r[-1] != label for r in rows)
    if c is None:
        return node, wrong
    left, inside, kept = [], 0, {}
    groups = {k: [] for k in children}
    for r in rows:
        key = None if r[c] is None else r[c] if edge is None else "low" if r[c] <= edge else "high"
        (groups[key] if key in groups else left).append(r)
    for k, child in children.items():
        kept[k], n = cut_back(child, groups[k])
        inside += n
    inside += sum(r[-1] != label for r in left)
    return ((label, c, edge, kept), inside) if inside < wrong else ((label, None, None, {}), wrong)


@pytest.mark.parametrize("depth,held_out", [(1, 0), (3, 0), (4, 35)])
def test_tree_against_recursion(spark, depth, held_out):
    rows = some_rows(2, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = tree.tree_fit(df, "class", keys=["id"], max_depth=depth, held_out=held_out)
    train, rest = rows, []
    if held_out:
        parts = tree.hash_split(df, [100 - held_out, held_out], ["id"])
        train, rest = (sorted(tuple(r) for r in p.collect()) for p in parts)
    want = grow(train, depth)
    if held_out:
        full = sum(classify(want, r) != r[-1] for r in rest)
        want, _ = cut_back(want, rest)
        assert sum(classify(want, r) != r[-1] for r in rest) <= full
    out = tree.tree_predict(model, df)
    assert out.columns == ["id", "a", "b", "s", "class", "predicted"]
    assert {r["id"]: r["predicted"] for r in out.collect()} == {r[0]: classify(want, r) for r in rows}


def test_many_values_are_binned(spark):
    df = spark.range(5000).selectExpr("CAST(id AS double) a", "CASE WHEN id < 2500 THEN 'x' ELSE 'y' END AS class")
    found = tree.number_bins(df, ["a"], 50).orderBy("bin").collect()
    assert len(found) == 50 and all(r["high"] - r["low"] == 99 for r in found)
    model = tree.tree_fit(df, "class", max_bins=50)
    assert [r["edge"] for r in model.nodes.collect()] == [2499.5]
    assert tree.tree_predict(model, df).where("class = predicted").count() == 5000


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(1, 1.0, 1, "p", "x")] * 5, SCHEMA)
    for frame in (df, df.limit(1)):
        model = tree.tree_fit(frame, "class", keys=["id"], held_out=20)
        assert model.depth == 0 and {r["predicted"] for r in tree.tree_predict(model, df).collect()} == {"x"}
    empty = tree.tree_fit(df.limit(0), "class", keys=["id"])
    assert tree.tree_predict(empty, df).where("predicted is null").count() == 5
