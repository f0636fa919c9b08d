import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelkite.llm import repeated_spans as R

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """Kept words of each row by comparing all windows."""
    words = [(i, SPLIT.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), " ".join([x for n, x in enumerate(w) if n not in gone])))
    return sorted(out, key=repr)


def got(frame):
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def passages(seed, n):
    """Documents of fresh words and of passages that others have as well, some cut, some twice in one."""
    rnd = random.Random(seed)
    common = [[f"c{p}_{j}" for j in range(rnd.choice([5, 13, 14, 30, 80]))] for p in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 12))]
            part = rnd.choice(common)
            a = rnd.randrange(len(part))
            words += part[a:] if rnd.random() < 0.3 else part
        rows.append((i * 7 % 1009, rnd.choice([" ", "\n", "  \t"]).join(words)))
    return rows


@pytest.fixture(scope="module")
def rows():
    loop = "a b " * 40
    odd = [(None, None), (None, loop), (2000, None), (2001, ""), (2002, " \x0b\n"), (2003, loop), (2004, "b " + loop),
           (2005, "x y " + loop), (2005, loop), (2006, "A B " * 30), (2007, "word " * 20_000), (2008, "word " * 30)]
    return passages(1, 60) + odd + passages(1, 60)[:3]


@pytest.mark.parametrize("k,short", [(13, 7), (3, 2)])
def test_against_brute_force(spark, rows, k, short):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("place", F.lit("x")).withColumn("marks", F.lit(1)).repartition(4)
    assert got(R.without_repeats(docs, k, short)) == brute(rows, k)


def test_spans_tell_where_they_come_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id < 2000")
    texts, spans = R.repeated_spans(docs)
    words = {(r["doc_id"], r["copy"]): SPLIT.findall(r["text"] or "") for r in texts.collect()}
    found = spans.collect()
    assert found
    for r in found:
        a, b = ((p >> R.COPY) + 1 for p in (r["place"], r["source_place"]))
        x, y = (p & ((1 << R.COPY) - 1) for p in (r["place"], r["source_place"]))
        own = words[r["doc_id"], a][x : x + r["length"]]
        assert own == words[r["source"], b][y : y + r["length"]] and r["source"] < r["doc_id"] and len(own) >= 13


def test_one_name_for_two_runs_stops_the_job(spark, monkeypatch):
    """Spans whose words are not those of their source are an error."""
    docs = spark.createDataFrame([(1, "a " * 20), (2, "b " * 20)], "doc_id long, text string")
    texts = docs.withColumn("copy", F.lit(1))
    spans = spark.createDataFrame([(2, 0, 3, 1, 0)], "doc_id long, place long, windows long, source long, source_place long")
    with pytest.raises(Exception, match="one name"):
        R.verified(spans, texts).collect()


def test_paths_end_at_branches(spark):
    """Two documents share a run that goes on in two ways: one path before the branch, one for each way."""
    common, left, right = ([f"{c}{i}" for i in range(20)] for c in "clr")
    rows = [(i, " ".join(common + (left if i % 2 else right))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit(1))
    marks = R.shared_marks(docs.select("doc_id", "text"))
    texts = docs.join(marks, "doc_id").select("doc_id", "copy", "text", "marks")
    edges = R.repeated_edges(texts.mapInArrow(lambda b: R._edges(b, R.WORDS, R.MARK), R.EDGES))
    paths = R.compacted(edges).groupBy("source", "start").count().collect()
    assert sorted((r["source"], r["start"], r["count"]) for r in paths) == [(0, 0, 8), (0, 8, 20), (1, 8, 20)]


def test_copies_stay_out_of_the_graph(spark):
    """Of equal texts one makes edges; each other is one span, also where ids repeat."""
    long, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    rows = [(3, long), (5, long), (5, other), (5, long), (7, other), (9, "p1 p2"), (11, "p1 p2"), (12, None), (13, None), (14, "z " + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    copies = R.equal_texts(docs.withColumn("name", F.md5("text"))).select("doc_id", "keep").collect()
    assert sorted(map(tuple, copies)) == [(5, 3), (7, 5), (11, 9)]
    _, spans = R.repeated_spans(docs)
    spans = sorted((r["doc_id"], r["place"] & ((1 << R.COPY) - 1), r["length"], r["source"]) for r in spans.collect())
    assert spans == [(5, 0, 40, 3), (5, 0, 40, 3), (7, 0, 40, 5), (14, 1, 40, 3)]
    assert got(R.without_repeats(docs)) == brute(rows, R.WORDS)


def test_nothing(spark, no_documents):
    assert R.without_repeats(no_documents).count() == 0


def test_marks_of_equal_windows_are_equal():
    text = " ".join(f"w{i}" for i in range(40))
    a, b = (R._as_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in (text, "x y " + text + " z"))
    _, x = R._window_marks(a, 13, 7)
    _, y = R._window_marks(b, 13, 7)
    assert x.tolist() == y[2:-1].tolist() and len(x) == 28
