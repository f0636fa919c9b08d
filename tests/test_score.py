"""Recorded confusion matrices of three census models, and the figures recorded with them."""

import pytest
from pyspark.sql import functions as F

from labelkite.operators import score

LOW, HIGH = "<=50K", ">50K"
# Counts (low-low, low-high, high-low, high-high), accuracy and kappa.
MATRICES = {
    "bayes": ((20561, 4159, 1814, 6027), 0.8165596879702712, 0.5447834502595315),
    "tree": ((24120, 600, 1035, 6806), 0.9497865544670004, 0.8600186673382124),
    "logit": ((23039, 1681, 3112, 4729), 0.8527993611989804, 0.5706667281128317),
}
# Recall, precision and F-measure by model and class.
BY_CLASS = {
    ("bayes", LOW): (0.8317556634304207, 0.9189273743016759, 0.8731712496018686),
    ("bayes", HIGH): (0.768651957658462, 0.5916944826232083, 0.6686636711599269),
    ("tree", LOW): (0.9757281553398058, 0.9588550983899821, 0.967218045112782),
    ("tree", HIGH): (0.8680015304170386, 0.9189846070753444, 0.8927657899914737),
    ("logit", LOW): (0.9319983818770227, 0.8809988145768805, 0.9057812899294294),
    ("logit", HIGH): (0.6031118479785742, 0.7377535101404056, 0.6636727247210722),
}


def predictions(spark, counts):
    cells = zip([(LOW, LOW), (LOW, HIGH), (HIGH, LOW), (HIGH, HIGH)], counts)
    df = spark.createDataFrame([(a, p, n) for (a, p), n in cells], "a string, p string, n int")
    every = df.select("a", "p", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    missing = spark.createDataFrame([(None, LOW, 1), (LOW, None, 1)], "a string, p string, i int")
    return every.unionByName(missing)


@pytest.mark.parametrize("model", list(MATRICES))
def test_recorded_scores(spark, model):
    counts, accuracy, kappa = MATRICES[model]
    df = predictions(spark, counts)
    total = score.scorer_totals(df, "a", "p").first()
    assert total["accuracy"] == pytest.approx(accuracy, abs=1e-12)
    assert total["error"] == pytest.approx(1 - accuracy, abs=1e-12)
    assert total["kappa"] == pytest.approx(kappa, abs=1e-12)
    assert (total["correct"], total["false"]) == (counts[0] + counts[3], counts[1] + counts[2])
    stats = {r["class"]: r for r in score.class_statistics(df, "a", "p").collect()}
    assert set(stats) == {LOW, HIGH, None} and len(stats[LOW]) == 12
    assert stats[None]["accuracy"] == pytest.approx(accuracy, abs=1e-12)
    assert stats[None]["kappa"] == pytest.approx(kappa, abs=1e-12)
    for name in (LOW, HIGH):
        recall, precision, f = BY_CLASS[model, name]
        r = stats[name]
        assert r["recall"] == r["sensitivity"] == pytest.approx(recall, abs=1e-12)
        assert r["precision"] == pytest.approx(precision, abs=1e-12)
        assert r["f_measure"] == pytest.approx(f, abs=1e-12)
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 32561
    assert stats[LOW]["specificity"] == pytest.approx(BY_CLASS[model, HIGH][0], abs=1e-12)
    matrix = {r["actual"]: r for r in score.confusion_matrix(df, "a", "p", [LOW, HIGH, "x"]).collect()}
    assert matrix[LOW][f"p_{HIGH}"] == counts[1] and matrix[HIGH][f"p_{LOW}"] == counts[2]
    assert matrix["x"][f"p_{LOW}"] == 0 and matrix[LOW]["p_x"] == 0


def test_buckets(spark, rows):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] * 2 + [("b", 2)] * 2 + [("c", 1)], "o string, i int")
    assert [tuple(r) for r in score.top_terms(df, "o", 2).collect()] == [("b", 4), ("a", 3)]
    got = rows(score.nested_terms(df, "o", "i", 2), "o", "i", "n", "rank")
    assert got == [("a", 1, 3, 1), ("b", 1, 2, 1), ("b", 2, 2, 2)]


def test_an_unknown_predicted_class_stops_the_matrix(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c")], "label string, predicted string")
    with pytest.raises(Exception, match="unknown class"):
        score.confusion_matrix(df, "label", "predicted", ["a", "b"]).collect()
