import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelkite.llm import bytehash, labelled
from labelkite.llm import quality_crf as Q

WORDS = ["the", "of", "reading", "stones", "and", "water", "old", "house", "went", "slowly", "over", "hill"]


def line(rnd, good):
    words = [rnd.choice(WORDS) for _ in range(rnd.randint(6, 14))]
    return " ".join(words).capitalize() + "." if good else " | ".join(rnd.choice(WORDS) + rnd.choice(["###", "$$$", "%%"]) for _ in words)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        lines = [line(rnd, good or rnd.random() < 0.2) for _ in range(rnd.randint(1, 12))]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    docs += [(1000, None), (1001, ""), (1002, "\n\n\n"), (1003, "one"), (None, docs[0][1]), (1, docs[1][1])]
    labels += [(2000, 1), (5, None), (7, 3), (8, 0), (8, 1), (None, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int"),
        dict(labels[:400]),
    )


def test_marginals_equal_enumeration():
    """Sums over all labellings of short chains, by hand."""
    rnd = np.random.default_rng(0)
    row = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    score, step = rnd.normal(size=8), rnd.normal(size=(2, 2))
    got, pairs = Q.Chains(row).marginals(score, step)
    seen = 0
    for r in range(3):
        at = np.flatnonzero(row == r)
        weight, one, two = 0.0, np.zeros(len(at)), np.zeros((len(at) - 1, 2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum((v - 0.5) * score[i] for v, i in zip(y, at)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            weight += w
            one += w * np.array(y)
            for k, (a, b) in enumerate(zip(y, y[1:])):
                two[k, a, b] += w
        assert np.allclose(got[at], one / weight)
        assert np.allclose(pairs[seen : seen + len(at) - 1], two / weight)
        seen += len(at) - 1


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    field = Q.fit(docs, labels, per_class=120)
    got = docs.select("doc_id", labelled.held_out("doc_id").alias("held"), Q.score("text", field).alias("score")).collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert np.mean([(r["score"] >= Q.THRESHOLD) == truth[r["doc_id"]] for r in held]) > 0.95
    empty = {r["score"] for r in got if r["doc_id"] in (1000, 1001, 1002)}
    assert empty == {field.empty}
    kept = Q.good_documents(docs.withColumn("score", F.lit("x")), field)
    assert kept.columns == ["doc_id", "text", "score"]
    assert kept.count() == sum(r["score"] >= Q.THRESHOLD for r in got)


def test_held_out_labels_are_not_learned_from(corpus):
    docs, labels, _ = corpus
    turned = labels.withColumn("quality", F.when(labelled.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels, per_class=50), Q.fit(docs, turned, per_class=50)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.shift) == (b.slope, b.shift)


def test_a_score_does_not_depend_on_its_neighbours(corpus):
    docs, labels, _ = corpus
    field = Q.fit(docs, labels, per_class=50)
    texts = [r["text"] for r in docs.collect()]
    together = field.scores(*bytehash.text_bytes(pa.array(texts)))
    alone = [field.scores(*bytehash.text_bytes(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone)


@pytest.mark.parametrize("wanted,score", [("quality is null", 0.5), ("quality = 1", 1.0), ("quality = 0", 0.0)])
def test_without_both_labels(corpus, no_documents, wanted, score):
    docs, labels, _ = corpus
    field = Q.fit(docs, labels.where(wanted))
    assert docs.select(F.min(F.abs(Q.score("text", field) - score))).first()[0] < 1e-5
    assert no_documents.select(Q.score("text", field)).count() == 0
    assert Q.fit(no_documents, labels).empty == 0.5
