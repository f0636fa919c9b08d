import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelkite.llm import jaccard_join as J
from labelkite.llm import components as C
from labelkite.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = SPLIT.findall((text or "").translate(LOWER))
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))


def smallest(vertices, links):
    """Union-find: the smallest vertex that links lead to."""
    up = {v: v for v in vertices}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {v: top(v) for v in vertices}


def brute(rows, k=3, similarity=Fraction(9, 10)):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = [i for i in sorted(sets) if sets[i]]
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    ]
    group = smallest(sets, links)
    return sorted((i, len(s), group[i]) for i, s in sets.items()), links


def copies(seed, n_bases, words, changes, per_base, start=0):
    """Near copies with a few changed words, so that some reach the similarity and some do not."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n_bases):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice(words))]
        for _ in range(per_base):
            w = list(base)
            for _ in range(rnd.randint(0, changes)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return [(start + i * 3 % 10007, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    found = copies(1, 12, [1, 2, 3, 9, 12, 25, 60, 130, 300], 3, 14)
    return found + [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, found[0][1]), (20_004, found[0][1].upper())]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def collected(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("words,similarity", [(3, Fraction(9, 10)), (5, Fraction(8, 10)), (2, Fraction(2, 3))])
def test_groups_equal_brute_force(spark, rows, words, similarity):
    want, links = brute(rows, words, similarity)
    assert len(links) > 30
    got = J.similar_groups(frame(spark, rows), words=words, similarity=similarity)
    assert collected(got) == want


def test_links_that_no_star_finds(spark):
    """Short texts of one signature where the centre is linked with nothing."""
    rows = copies(4, 3, [22], 6, 60)
    want, links = brute(rows)
    assert links
    assert collected(J.similar_groups(frame(spark, rows, 5))) == want


def test_blocks_let_out_near_sets_only():
    """Large sets that 64 cells cannot tell apart; near pairs of many signatures come out in bounded batches."""
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(1, 2**63, 1500, dtype=np.uint64)) for _ in range(60)]
    sets += [np.append(s[1:], np.uint64(7)) for s in sets[:4]]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketches = [x.tobytes() for x in J._sketches(np.concatenate(sets), ends)]
    sizes = np.diff(ends)
    rows = [(0, 0, 0, i, 0, i, int(sizes[i]), sketches[i]) for i in range(64)]
    names = ["signature", "low", "high", "doc_id", "own", "component", "n_shingles", "sketch"]

    def pairs(rows):
        batches = J._block_pairs(iter([J.pa.table(dict(zip(names, zip(*rows)))).to_batches()[0]]), Fraction(8, 10))
        return [list(zip(b["a"].to_pylist(), b["b"].to_pylist())) for b in batches]

    assert pairs(rows) == [[(i, 60 + i) for i in range(4)]]
    copies = [(s, 0, 0, s * 600 + i, 0, i, 1500, sketches[0]) for s in range(3) for i in range(512)]
    found = pairs(copies)
    assert max(map(len, found)) < J.OUT + 512 and len(set(sum(found, []))) == 3 * 512 * 511 // 2


def test_a_large_group(spark):
    """Hundreds of near copies of one text, some equal, and a chain of them."""
    rows = copies(9, 1, [80], 2, 400)
    want, _ = brute(rows)
    assert collected(J.similar_groups(frame(spark, rows, 6))) == want


def test_one_of_each_group_stays(spark, rows):
    docs = frame(spark, [*rows, (None, "a b c"), (None, "a b c")]).withColumn("vertex", F.lit(0)).withColumn("wanted", F.lit(1))
    kept = J.first_of_groups(docs)
    assert kept.columns == docs.columns
    want = [i for i, _, g in brute(rows)[0] if i == g]
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 2


def test_nothing(no_documents):
    assert J.similar_groups(no_documents).count() == 0
    assert J.first_of_groups(no_documents).count() == 0


@pytest.mark.parametrize("similarity", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_sets_that_reach_the_similarity_share_a_signature(similarity):
    """PartEnum's promise, on sets at and near the limit of many sizes."""
    rnd = np.random.default_rng(11)
    for n in [1, 2, 5, 9, 10, 11, 19, 20, 33, 64, 100, 257, 900]:
        for _ in range(8):
            base = np.unique(rnd.integers(1, 2**63, n, dtype=np.uint64))
            drop = rnd.integers(0, max(1, int(n * (1 - similarity))) + 1)
            other = np.unique(np.concatenate([base[drop:], rnd.integers(1, 2**63, rnd.integers(0, drop + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(base, other))
            if not len(other) or common < similarity * (len(base) + len(other) - common) or np.array_equal(base, other):
                continue
            found, row = J.signatures(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]), similarity)
            assert set(found[row == 0].tolist()) & set(found[row == 1].tolist())


def test_components_of_random_links(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)]
    links += [(900, i) for i in range(901, 980)] + [(7, 7)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest({v for e in links if e[0] != e[1] for v in e}, links[:-1])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_few_links_write_few_files(spark, monkeypatch):
    """However many partitions the session has: each file of a round costs a task, and processes on a local folder."""
    made = []
    store = C.written
    monkeypatch.setattr(C, "written", lambda *a, **b: (made.append(store(*a, **b)), made[-1])[1])
    monkeypatch.setattr(C, "forget", lambda table: None)
    links = spark.range(2000).selectExpr("id - id % 5 AS a", "id AS b")
    before = {k: spark.conf.get(k) for k in ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]}
    try:
        for k, v in zip(before, ["40", "false"]):
            spark.conf.set(k, v)
        assert components(links).count() == 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(made) > 4 and all(len(t.inputFiles()) <= 1 for t in made[1:])
