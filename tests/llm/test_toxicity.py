import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelkite.llm import labelled
from labelkite.llm import toxicity as T

STEMS = ["ra", "to", "mi", "len", "sor", "ket", "ua", "pin", "dor", "vel"]
BAD = ["grubnak", "snorple", "wexfool"]


def word(rnd):
    return "".join(rnd.choice(STEMS) for _ in range(rnd.randint(1, 4)))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [word(rnd) for _ in range(rnd.randint(10, 80))]
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) if i % 4 else "zaxor" + word(rnd))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "GRUBNAK " * 3000), (None, "ra"), (1, docs[1][1])]
    labels += [(9000, 1), (5, None), (8, 1), (None, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
        dict(labels[:1200]),
    )


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    scorer = T.fit(docs, labels)
    got = docs.select("doc_id", labelled.held_out("doc_id").alias("held"), T.score("text", scorer).alias("score")).collect()
    assert len(got) == 1205 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    toxic = [r["score"] for r in held if truth[r["doc_id"]]]
    clean = [r["score"] for r in held if not truth[r["doc_id"]]]
    assert len(toxic) > 20
    assert np.mean(np.array(toxic) >= 0.5) > 0.9 and np.mean(np.array(clean) >= 0.5) < 0.02
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[5000] == by_id[5001] < 0.5


def test_held_out_labels_are_not_learned_from(corpus):
    docs, labels, _ = corpus
    turned = labels.withColumn("toxic", F.when(labelled.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, labels, per_class=60), T.fit(docs, turned, per_class=60)
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


def test_the_label_model_corrects_labels_and_allows_for_correlated_voters():
    """Two kinds of toxic documents, each with its own voters, one copied ten times; a tenth of the labels is wrong."""
    rnd = np.random.default_rng(1)
    y = rnd.random(6000) < 0.3
    kind = rnd.random(6000) < 0.5
    one = rnd.random((6000, 3)) < np.where(y & kind, 0.8, 0.05)[:, None]
    two = rnd.random((6000, 3)) < np.where(y & ~kind, 0.8, 0.05)[:, None]
    votes = np.concatenate([one, two, np.repeat(two[:, 2:], 9, 1)], 1).astype(float)
    given = np.where(rnd.random(6000) < 0.9, y, ~y).astype(int)
    q = T.posterior_labels(votes, given)
    assert np.mean((q > 0.5) == y) > 0.95


def test_without_both_labels(corpus, no_documents):
    docs, labels, _ = corpus
    for some, score in ((labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("false"), 0.0)):
        got = docs.select(T.score("text", T.fit(docs, some)).alias("s")).agg(F.min("s"), F.max("s")).first()
        assert max(abs(got[0] - score), abs(got[1] - score)) < 1e-5
    scorer = T.fit(no_documents, labels)
    assert no_documents.select(T.score("text", scorer)).count() == 0
