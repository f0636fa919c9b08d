import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors

from labelkite.operators import linear, tree
from labelkite.shared import fresh_path, written
from labelkite.sources import models


def separable(spark, n=200):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        y = k % 2
        x = rng.normal(size=4) + (2.5 if y else -2.5)
        rows.append((float(y), Vectors.sparse(4, list(range(4)), [float(v) for v in x])))
    return spark.createDataFrame(rows, ["label", "features"])


def descent(points, iterations, step, reg):
    """Full-batch hinge descent in plain numpy; it stops where the weights hardly move."""
    x = np.array([r["features"].toArray() for r in points])
    y = np.array([2 * r["label"] - 1 for r in points])
    w = np.zeros(x.shape[1])
    for t in range(1, iterations + 1):
        inside = y * (x @ w) < 1
        g = -(y[inside, None] * x[inside]).sum(axis=0) / len(y)
        rate = step / np.sqrt(t)
        last, w = w, w * (1 - rate * reg) - rate * g
        if t > 1 and np.linalg.norm(w - last) < 1e-3 * max(np.linalg.norm(w), 1):
            break
    return w


def test_svm_is_plain_descent(spark):
    df = separable(spark)
    points = df.collect()
    rows = [(i, 2 * r["label"] - 1, f"t{j}", float(v)) for i, r in enumerate(points) for j, v in enumerate(r["features"].toArray())]
    terms = spark.createDataFrame([(f"t{j}",) for j in range(4)], "term string")
    table = spark.createDataFrame(rows, "id long, y double, term string, value double")
    found = linear.hinge_descent(written(table, "points"), terms, len(points), "id", 10, 0.1, 0.01)
    got = np.array([r["weight"] for r in found.orderBy("term").collect()])
    assert got == pytest.approx(descent(points, 10, 0.1, 0.01), abs=1e-9)
    quasi = linear.svm_fit(df)
    for w in (got, quasi):
        right = [(r["features"].toArray() @ w > 0) == (r["label"] == 1.0) for r in points]
        assert np.mean(right) > 0.97


def test_logistic(spark):
    df = separable(spark)
    for model in (linear.logistic_fit(df), linear.logistic_l2_fit(df, c=1.0)):
        right = model.transform(df).where("label = prediction").count()
        assert right >= 195


def test_l2_logistic_minimizes_its_objective(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=80) > 0).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    model = linear.logistic_l2_fit(df, c=0.5)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert w + 0.5 * x.T @ (p - y) == pytest.approx(np.zeros(3), abs=1e-3)
    assert 0.5 * (p - y).sum() == pytest.approx(0, abs=1e-3)


def test_score_by_model(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["z"]), (3, [])], "id long, tokens array<string>")
    weights = spark.createDataFrame([("a", 2, 1.5), ("b", 1, -0.5)], "term string, doc_freq long, weight double")
    got = linear.score_by_model(docs, weights, "id", [])
    assert {r["id"]: r["margin"] for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def mixed(spark, n=600):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(n):
        age, job = float(rng.normal(40, 10)), "abc"[rng.integers(3)]
        score = 0.1 * (age - 40) + {"a": 0.0, "b": 1.0, "c": -1.0}[job]
        rows.append((age, job, "high" if rng.uniform() < 1 / (1 + np.exp(-score)) else "low"))
    return spark.createDataFrame(rows, "age double, job string, class string"), rows


def test_logit_table_against_newton(spark):
    df, rows = mixed(spark)
    model = linear.logit_fit(df, "class", "high")
    got = {r["variable"]: r for r in linear.logit_table(model, spark, "high").collect()}
    x = np.array([[a, j == "b", j == "c", 1.0] for a, j, _ in rows], dtype=float)
    y = np.array([c == "high" for _, _, c in rows], dtype=float)
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        h = x.T @ (x * (p * (1 - p))[:, None])
        w = w + np.linalg.solve(h, x.T @ (y - p))
    std = np.sqrt(np.diag(np.linalg.inv(h)))
    assert set(got) == {"age", "job=b", "job=c", "Constant"}
    for k, name in enumerate(["age", "job=b", "job=c", "Constant"]):
        assert got[name]["coeff"] == pytest.approx(w[k], abs=1e-5)
        assert got[name]["std_err"] == pytest.approx(std[k], rel=1e-3)
        assert got[name]["z_score"] == pytest.approx(w[k] / std[k], rel=1e-3, abs=1e-4)
        assert 0 <= got[name]["p_value"] <= 1
    out = linear.logit_predict(model, df, "high", "low", "predicted")
    assert out.columns == ["age", "job", "class", "predicted"]
    want = ["high" if v > 0 else "low" for v in x @ w]
    assert [r["predicted"] for r in out.collect()] == want


def test_logit_of_missing_cells_and_too_many_variables(spark):
    df, rows = mixed(spark, 200)
    holes = df.unionByName(spark.createDataFrame([(None, "a", "high"), (1.0, None, "low"), (2.0, "b", None)], df.schema))
    a, b = (linear.logit_fit(x, "class", "high") for x in (df, holes))
    assert a.coefficients == pytest.approx(b.coefficients) and a.rounds < 10
    out = linear.logit_predict(a, holes.withColumn("job", F.coalesce("job", F.lit("zz"))), "high", "low", "predicted")
    assert out.where("predicted is null").count() == 1  # the row without a number
    with pytest.raises(ValueError, match="more than 2"):
        linear.logit_fit(df, "class", "high", max_columns=2)


def test_tree(spark):
    """A rule of two steps, which greedy splits reach without a leaf below two records."""
    df = spark.createDataFrame(
        [(float(k), "ab"[k % 2], "yes" if k >= 50 and k % 2 == 0 else "no") for k in range(100)],
        "v double, s string, class string",
    )
    model = tree.tree_fit(df, "class")
    out = tree.tree_predict(model, df)
    assert out.columns == ["v", "s", "class", "predicted"]
    assert out.where("class = predicted").count() == 100
    new = spark.createDataFrame([(3.0, "zz", "yes")], "v double, s string, class string")
    assert tree.tree_predict(model, new).count() == 1


def test_stored_table_models(spark):
    """A tree and a logistic model, read back, give the same classes."""
    df, _ = mixed(spark, 200)
    root = fresh_path(spark, "models")
    for name, model in (("tree", tree.tree_fit(df, "class", max_depth=4)), ("logit", linear.logit_fit(df, "class", "high"))):
        models.write_model(model, root, name)
        if name == "tree":
            loaded = models.load_tree(spark, root, name)
        else:
            loaded = models.load_logit(spark, root, name)
            assert (loaded.covariance == model.covariance).all() and loaded.variables() == model.variables()
        if name == "tree":
            a, b = tree.tree_predict(model, df), tree.tree_predict(loaded, df)
        else:
            a, b = (linear.logit_predict(m, df, "high", "low", "predicted") for m in (model, loaded))
        assert a.collect() == b.collect()


def test_kernel_features_tell_what_a_line_cannot(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(a * b > 0)) for a, b in rng.uniform(-1, 1, size=(400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    model, features = linear.svm_rbf_fit(df, ["a", "b"], c=10.0, sigma=0.5, n=100)
    out = linear.svm_rbf_predict(model, features, df, ["no", "yes"], "predicted")
    right = out.where("(label = 1.0) = (predicted = 'yes')").count()
    assert right > 360 and out.columns == ["a", "b", "label", "predicted"]


def test_kernel_features_approach_the_kernel(spark):
    df = spark.createDataFrame([([0.1, 0.2],), ([0.4, -0.1],)], "x array<double>")
    z = [np.array(r[0]) for r in df.select(linear.fourier_features("x", 2, 0.5, 4000, 1)).collect()]
    want = np.exp(-(0.3**2 + 0.3**2) / (2 * 0.5**2))
    assert z[0] @ z[1] == pytest.approx(want, abs=0.05)
    assert z[0] @ z[0] == pytest.approx(1.0, abs=0.05)


def test_term_descent_against_newton(spark):
    """The penalised optimum, the constant without penalty, and documents and terms that tell nothing."""
    rng = np.random.default_rng(8)
    x = (rng.uniform(size=(60, 8)) < 0.4).astype(float)
    y = np.where(x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.7, 60) > 0.4, 1.0, -1.0)
    docs = [(i, "positive" if y[i] > 0 else "negative", [f"t{j}" for j in np.flatnonzero(x[i])] + ["unknown"]) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, label string, tokens array<string>")
    spec = spark.createDataFrame([(f"t{j}", 1) for j in range(8)] + [("absent", 1)], "term string, doc_freq long")
    full = np.column_stack([x, np.ones(60)])
    for c in (0.5, None):
        if c is None:
            full, ridge = x, np.zeros(8)
        else:
            ridge = np.array([1 / (c * 60)] * 8 + [0.0])
        w = np.zeros(full.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(full @ w)))
            h = full.T @ (full * (p * (1 - p))[:, None]) / 60 + np.diag(ridge)
            w -= np.linalg.solve(h, full.T @ (p - (y > 0)) / 60 + ridge * w)
        out = linear.logistic_terms_fit(df, spec, "id", "label", "positive", c, iterations=25)
        got = {r["term"]: r["weight"] for r in out.collect()}
        # Without a penalty the optimum is flat.
        assert [got[f"t{j}"] for j in range(8)] == pytest.approx(w[:8].tolist(), abs=1e-4 if c else 2e-3) and got["absent"] == 0
        assert (linear.BIAS in got) == (c is not None)
        if c is not None:
            assert got[linear.BIAS] == pytest.approx(w[8], abs=1e-4)
            few = linear.logistic_terms_fit(df, spec, "id", "label", "positive", c, iterations=3)
            wide = linear.logistic_terms_fit(df, spec, "id", "label", "positive", c, iterations=3, max_bytes=1)
            a, b = ({r["term"]: r["weight"] for r in f.collect()} for f in (few, wide))
            assert a == pytest.approx(b, abs=1e-9)


def test_kernel_features_are_never_stored(spark, monkeypatch):
    """The learner stores the cells alone, reaches the quasi-Newton learner's objective, and leaves out missing cells."""
    stored = []
    monkeypatch.setattr(linear, "written", lambda df, *a, **k: stored.append(written(df, *a, **k)) or stored[-1])
    monkeypatch.setattr(linear, "forget", lambda table: None)
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(a * b > 0)) for a, b in rng.uniform(-1, 1, size=(200, 2))]
    df = spark.createDataFrame([*rows, (None, 0.5, 1.0)], "a double, b double, label double")
    model, cells = linear.svm_rbf_fit(df, ["a", "b"], c=10.0, sigma=0.5, n=40)
    assert [t.columns for t in stored] == [["x", "y"]]
    assert stored[0].select(F.max(F.size("x")), F.count("*")).first() == (2, 200)
    features = array_to_vector(linear.fourier_features(F.array("a", "b"), 2, 0.5, 40, 42)).alias("features")
    plain = LinearSVC(maxIter=100, regParam=1.0 / (10.0 * 200), standardization=False)
    former = plain.fit(df.where("a is not null").select("label", features).cache())
    assert model.loss <= former.summary().objectiveHistory[-1] + 2e-3
    out = linear.svm_rbf_predict(model, cells, df, ["no", "yes"], "predicted")
    assert out.where("predicted is null").count() == 1 and out.where("a is null and predicted is null").count() == 1


def test_a_pass_over_documents_shuffles_no_points(spark):
    """Margins and sums by term, from one row for each document, by a vector of weights or by joins."""
    points = [(i, 1.0 if i % 2 else -1.0, f"t{j}", float(j + 1)) for i in range(30) for j in range(4) if (i + j) % 3]
    points += [(99, 1.0, "unknown", 1.0)]
    df = spark.createDataFrame(points, "id long, y double, term string, value double")
    terms = spark.createDataFrame([(f"t{j}",) for j in range(5)], "term string")
    found = []
    for limit in (10**6, 1):
        rows = linear.term_rows(df, terms, "id", limit)
        assert rows.table.count() == 30 and rows.table.columns == ["id", "y", "idx", "value"]
        weights = written(rows.terms.select("idx", (F.col("idx") - 1.5).alias("w"), F.lit(2.0).alias("d")), "weights")
        margins = rows.margins(weights, ["w", "d"])
        pulls = rows.pulls(weights, "w", lambda y, m: y * (y * m < 1))
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (margins, pulls)]
        assert ("Join" in plans[0] or "Join" in plans[1]) == (limit == 1)
        found.append((sorted(map(tuple, margins.collect())), {r["idx"]: r["g"] for r in pulls.collect() if r["g"]}))
    want = []
    for i in range(30):
        own = [(j, float(j + 1)) for j in range(4) if (i + j) % 3]
        want.append((1.0 if i % 2 else -1.0, sum(v * (j - 1.5) for j, v in own), sum(2 * v for _, v in own)))
    assert [x for r in found[0][0] for x in r] == pytest.approx([x for r in sorted(want) for x in r])
    assert [x for r in found[0][0] for x in r] == pytest.approx([x for r in found[1][0] for x in r])
    assert found[0][1] == pytest.approx(found[1][1]) and found[0][1]
