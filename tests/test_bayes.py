import math

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from labelkite.functions import encode_label, tokenize
from labelkite.operators import bayes, linear, mixed_bayes, vectors, vocab
from labelkite.shared import fresh_path, written
from labelkite.sources import models

from places import SMALL

# Three documents and their classes.
ANIMALS = [(1, "dog cat goldfish", "0"), (2, "cat goldfish hamster", "0"), (3, "goldfish hamster shark", "1")]


def animals(spark):
    df = spark.createDataFrame(ANIMALS, "id long, text string, label string")
    return df.select("id", "label", tokenize("text").alias("tokens"))


def test_count_vectors_of_the_hand_example(spark):
    docs = animals(spark)
    spec, length = vocab.vocabulary_spec(vocab.doc_freq(docs, min_doc_freq=1), "animals")
    assert length == 5
    assert [r["term"] for r in spec.orderBy("idx").collect()] == ["cat", "dog", "goldfish", "hamster", "shark"]
    got = vectors.doc_vectors(docs, spec, "id", number="tf").orderBy("id").collect()
    assert [r["indices"] for r in got] == [[0, 1, 2], [0, 2, 3], [2, 3, 4]]
    assert all(r["values"] == [1.0, 1.0, 1.0] for r in got)
    counts = vectors.term_counts(docs, "id")
    assert counts.count() == 9
    assert vocab.doc_freq(docs).count() == 3


def test_vector_rules(spark):
    docs = spark.createDataFrame([(1, ["b", "b", "z"]), (2, []), (3, ["z"])], "id long, tokens array<string>")
    spec = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "term string, idx long, doc_freq long")
    got = {r["id"]: r for r in vectors.doc_vectors(docs, spec, "id", number="tf").collect()}
    assert (got[1]["indices"], got[1]["values"]) == ([1], [2.0])
    assert got[2]["indices"] == [] and got[3]["indices"] == []
    assert vectors.doc_vectors(docs, spec, "id").where("id = 1").first()["values"] == [1.0]
    ml = vectors.ml_vectors(vectors.doc_vectors(docs, spec, "id"), 2)
    assert {r["id"]: list(r["features"].toArray()) for r in ml.collect()} == {
        1: [0.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]
    }


TOKEN_ROWS = [(1, ["b", "a", "b", "z"]), (2, []), (3, ["z"]), (4, None), (5, ["c", None, "a"]), (5, ["a", "b"]), (None, ["b"])]


@pytest.mark.parametrize("number", ["occurrence", "tf"])
def test_terms_are_looked_up_inside_rows(spark, number):
    """No token becomes a row; rows, nulls and repeated ids are as by the join of tokens."""
    docs = spark.createDataFrame(TOKEN_ROWS, "id long, tokens array<string>").repartition(3)
    spec = spark.createDataFrame([("b", 0, 2), ("c", 7, 2), ("a", 3, 2)], "term string, idx long, doc_freq long")
    found = vectors.doc_vectors(docs, spec, "id", number=number)
    assert "tokens" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "explode" in x)
    joined = vectors.doc_vectors(docs, spec, "id", number=number, max_bytes=0)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted(map(tuple, joined.collect()), key=repr)
    assert (5, [0, 3, 7], [1.0, 1.0 if number == "occurrence" else 2.0, 1.0]) in got and len(got) == 6


def test_relational_bayes_equals_the_ml_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").join(
        spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id"
    )
    label = F.when(F.col("quality") == 1, "positive").otherwise("negative")
    docs = docs.select("doc_id", label.alias("label"), tokenize("text").alias("tokens"))
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    spec, length = vocab.vocabulary_spec(vocab.doc_freq(docs), "s")
    spec = written(spec, "spec")
    model = bayes.multinomial_fit(train, spec)
    got = {r["doc_id"]: r["predicted"] for r in bayes.multinomial_predict(model, test, "doc_id", []).collect()}

    def coded(part):
        v = vectors.doc_vectors(part, spec, "doc_id", ["label"]).withColumn("label", encode_label(F.col("label")))
        return vectors.ml_vectors(v, length)

    ml = NaiveBayes(smoothing=1.0).fit(coded(train))
    want = {r["doc_id"]: r["prediction"] for r in ml.transform(coded(test)).collect()}
    assert got == {d: "positive" if p == 1.0 else "negative" for d, p in want.items()}
    weights = {(r["term"], r["label"]): r["weight"] for r in model.weights().collect()}
    theta = ml.theta.toArray()
    for r in spec.collect():
        assert weights[r["term"], "positive"] == pytest.approx(theta[1, r["idx"]], abs=1e-9)
        assert weights[r["term"], "negative"] == pytest.approx(theta[0, r["idx"]], abs=1e-9)


def test_document_without_known_terms_gets_the_prior(spark):
    docs = animals(spark)
    model = bayes.multinomial_fit(docs, written(vocab.doc_freq(docs, min_doc_freq=1), "v"))
    other = spark.createDataFrame([(9, ["zebra"]), (10, [])], "id long, tokens array<string>")
    got = bayes.multinomial_predict(model, other, "id", []).collect()
    assert sorted((r["id"], r["predicted"]) for r in got) == [(9, "0"), (10, "0")]
    assert all(r["score"] == pytest.approx(math.log(3 / 5), abs=1e-8) for r in got)


def test_scores_need_no_row_by_token(spark):
    """Sums are made where a document's tokens lie, and are as by the join of tokens."""
    docs = spark.createDataFrame(TOKEN_ROWS, "id long, tokens array<string>").repartition(3)
    table = spark.createDataFrame([("b", 1.5), ("c", 4.0), ("a", 0.25)], "term string, w double")
    sums = {"s": F.col("w") * 2, "t": -F.col("w")}
    found = vectors.document_sums(docs, table, "id", [], sums)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted(map(tuple, vectors.document_sums(docs, table, "id", [], sums, max_bytes=0).collect()), key=repr)
    assert (1, 2, 3.5, -1.75) in got and (4, 0, 0.0, 0.0) in got and (5, 4, 12.0, -6.0) in got
    model = bayes.multinomial_fit(animals(spark), written(vocab.doc_freq(animals(spark), min_doc_freq=1), "v"))
    for frame in (
        bayes.multinomial_predict(model, animals(spark), "id", ["label"]),
        linear.score_by_model(docs, table.withColumnRenamed("w", "weight"), "id", []),
    ):
        assert "explode" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_predicted_field(spark):
    docs = spark.createDataFrame(ANIMALS, "id long, text string, label string")
    model = bayes.multinomial_fit(
        docs.withColumn("tokens", tokenize("text")),
        written(vocab.doc_freq(docs.select(tokenize("text").alias("tokens")), min_doc_freq=1), "v"),
    )
    got = bayes.predicted_field(docs, model, "id", tokenize("text"))
    assert got.columns == ["id", "text", "label", "predicted"]
    assert {r["id"]: r["predicted"] for r in got.collect()} == {1: "0", 2: "0", 3: "1"}


def test_stored_model_is_the_same(spark):
    docs = animals(spark)
    model = bayes.multinomial_fit(docs, written(vocab.doc_freq(docs, min_doc_freq=1), "v"))
    root = fresh_path(spark, "models")
    models.write_model(model, root, "nb", "spec")
    loaded = models.load_term_bayes(spark, root, "nb", "spec")
    assert (loaded.classes, loaded.docs, loaded.totals, loaded.length) == (
        model.classes, model.docs, model.totals, model.length
    )
    bad = spark.createDataFrame([("x", 1)], "label string, docs long")
    models.write_parameters(bad, root, "term_bayes_classes", "nb2", "spec")
    with pytest.raises(ValueError):
        models.load_parameters(spark, root, "term_bayes_classes", "nb2", "spec")


# Recorded sums and square sums by class; 24720 and 7841 rows.
SIZES = {"<=50K": 24720, ">50K": 7841}
SUMS = {
    ("age", "<=50K"): (909294, 38306070),
    ("age", ">50K"): (346963, 16220553),
    ("education-num", "<=50K"): (237190, 2422556),
    ("education-num", ">50K"): (91047, 1101807),
}
# Figures recorded with them.
MEAN, STD = 9.595064724919094, 2.3851286326650794


def with_sums(n, total, squares):
    """Whole numbers with the given count, sum and square sum: a search over neighbouring values."""
    low, more = divmod(total, n)
    values = [low + 1] * more + [low] * (n - more)
    lack = squares - sum(v * v for v in values)
    i, j = 0, n - 1
    while lack > 0:
        a, b = values[i], values[j]
        step = 1
        while 2 * (step + 1) * (a - b + step + 1) <= lack and step < 40:
            step += 1
        gain = 2 * step * (a - b + step)
        if gain > lack:
            i, j = i + 1, j - 1
            if i >= j:
                break
            continue
        values[i], values[j], lack = a + step, b - step, lack - gain
        i, j = i + 1, j - 1
        if i >= j:
            break
    return values, lack


def test_statistics_follow_from_the_recorded_sums(spark):
    """Mean and sample deviation as recorded, from data with the recorded sums."""
    for (name, label), (total, squares) in SUMS.items():
        n = SIZES[label]
        mean = total / n
        std = math.sqrt((squares - n * mean * mean) / (n - 1))
        if (name, label) == ("education-num", "<=50K"):
            assert mean == pytest.approx(MEAN, abs=1e-12)
        if (name, label) == ("education-num", ">50K"):
            assert std == pytest.approx(STD, abs=1e-9)
        values, lack = with_sums(n, total, squares)
        data = [(float(v), label) for v in values]
        df = spark.createDataFrame(data, "x double, class string")
        r = mixed_bayes.numeric_sums(df, "class", ["x"]).first()
        assert (r["n"], r["sum"], r["square_sum"]) == (n, total, squares - lack)
        assert r["mean"] == pytest.approx(mean, abs=1e-9)
        if lack == 0:
            assert r["std"] == pytest.approx(std, abs=1e-9)


def mixed_data(spark):
    return spark.createDataFrame(
        [
            (1.0, "a", "x", "p"), (2.0, "a", "y", "p"), (3.0, "b", "x", "p"), (None, "a", None, "p"),
            (7.0, "c", "x", "q"), (9.0, "c", "y", "q"), (8.0, "b", "y", "q"), (5.0, "a", "x", None),
        ],
        "v double, s string, t string, class string",
    )


def test_mixed_bayes_by_hand(spark):
    df = mixed_data(spark)
    model = mixed_bayes.mixed_fit(df, "class")
    assert model.classes == {"p": 4, "q": 3}
    assert model.gauss["v"]["p"] == (3, 2.0, 1.0) and model.gauss["v"]["q"] == (3, 8.0, 1.0)
    assert model.counts["s"] == {"a": {"p": 3}, "b": {"p": 1, "q": 1}, "c": {"q": 2}}
    stats = model.statistics(spark).collect()
    assert len(stats) == 2 + 6 + 4 + 2
    assert ("s", "c", "p", 0) in [tuple(r)[:4] for r in stats]

    def by_hand(v, s, t):
        scores = {}
        for c, mean in (("p", 2.0), ("q", 8.0)):
            p = math.log(model.classes[c] / 7)
            if v is not None:
                p += -0.5 * math.log(2 * math.pi) - (v - mean) ** 2 / 2
            for name, value in (("s", s), ("t", t)):
                if value is not None:
                    counts = model.counts[name]
                    share = counts.get(value, {}).get(c, 0) / sum(x.get(c, 0) for x in counts.values())
                    p += math.log(share) if share else -math.inf
            scores[c] = p
        if all(x == -math.inf for x in scores.values()):
            return "p"
        return max(sorted(scores), key=scores.get)

    cases = [(2.0, "a", "x"), (8.0, "b", "y"), (5.5, "b", "x"), (None, "b", None), (2.0, "c", "x"),
             (8.0, "unseen", "x"), (None, None, None)]
    new = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v double, s string, t string")
    got = {r["i"]: r["pred"] for r in model.predict(new, "pred").collect()}
    assert got == {i: by_hand(*c) for i, c in enumerate(cases)}
    again = mixed_bayes.MixedBayes.from_statistics(model.statistics(spark), "class")
    assert {r["i"]: r["pred"] for r in again.predict(new, "pred").collect()} == got


def test_mixed_bayes_skips_wide_columns_and_merges(spark):
    df = mixed_data(spark)
    narrow = mixed_bayes.mixed_fit(df, "class", max_nominal=2)
    assert set(narrow.counts) == {"t"} and narrow.skipped == ["s"]
    again = mixed_bayes.MixedBayes.from_statistics(narrow.statistics(spark), "class")
    assert again.skipped == ["s"] and again.counts == narrow.counts and again.classes == narrow.classes
    whole = mixed_bayes.sufficient_stats(df, "class", ["v"], ["s", "t"])
    halves = [
        mixed_bayes.sufficient_stats(df.where(w), "class", ["v"], ["s", "t"])
        for w in ("t = 'x'", "t is null or t != 'x'")
    ]
    added = halves[0].unionByName(halves[1]).groupBy("class", "name", "value").agg(
        *[F.sum(c).alias(c) for c in ("n", "sum", "square_sum")]
    )
    columns = ["class", "name", "value", "n", "sum", "square_sum"]
    assert sorted(map(repr, added.select(*columns).collect())) == sorted(map(repr, whole.select(*columns).collect()))
