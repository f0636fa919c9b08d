"""Linear classifiers: support vectors by gradient descent, logistic regression, kernel features."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.operators.mixed_bayes import split_kinds
from labelkite.operators.prepare import NUMERIC
from labelkite.operators.skew import dense_index, lookup_join, small_rows
from labelkite.operators.vectors import document_sums, occurrences
from labelkite.shared import forget, written


DENSE_BYTES = 128 * 1024 * 1024  # of a vector of all terms' weights that tasks hold


@dataclass(frozen=True)
class TermRows:
    """Stored documents ``(id, y, idx, value)`` with the numbers of their terms in arrays, and the terms' table.

    A document's terms lie in its row, so a sum by document needs no shuffle: tasks look weights up in a
    vector of all terms, and add up by term before they send anything. A vector above ``max_bytes`` is
    not sent to tasks; rows and weights are then joined by term.
    """

    table: DataFrame
    terms: DataFrame  # term, idx
    n: int
    id: str
    dense: bool

    def _vectors(self, weights: DataFrame, names: list[str]):
        found = weights.select("idx", *names).toArrow()
        vectors, at = np.zeros((len(names), self.n)), found.column("idx").to_numpy()
        for k, name in enumerate(names):
            vectors[k, at] = found.column(name).to_numpy()
        return self.table.sparkSession.sparkContext.broadcast(vectors)

    def _points(self) -> DataFrame:
        return self.table.select(self.id, "y", F.inline(F.arrays_zip("idx", "value")))

    def margins(self, weights: DataFrame, names: list[str]) -> DataFrame:
        """``(y, names...)``: each document's sums of value times each of the columns ``names`` of ``weights``."""
        if not self.dense:
            known = lookup_join(self._points(), weights.select("idx", *names), "idx", max_bytes=1)
            sums = known.groupBy(self.id, "y").agg(*[F.sum(F.col(c) * F.col("value")).alias(c) for c in names])
            return sums.select("y", *names)
        sent = self._vectors(weights, names)

        def rows(batches):
            for batch in batches:
                y, found = _document_sums(batch, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(y), *map(pa.array, found)], ["y", *names])

        return self.table.select("y", "idx", "value").mapInArrow(rows, ", ".join(f"{c} double" for c in ["y", *names]))

    def pulls(self, weights: DataFrame, name: str, pull) -> DataFrame:
        """``(idx, g)``: the sum by term of value times ``pull(y, margin)`` of its documents."""
        n = self.n
        if not self.dense:
            own = F.pandas_udf(lambda y, m: pd.Series(pull(y.to_numpy(), m.to_numpy())), "double")
            known = lookup_join(self._points(), weights.select("idx", name), "idx", max_bytes=1)
            sums = known.groupBy(self.id, "y").agg(F.sum(F.col(name) * F.col("value")).alias("m"))
            pulled = sums.select(self.id, own("y", "m").alias("pull")).where("pull != 0")
            found = self._points().drop("y").join(pulled, self.id)
            return found.groupBy("idx").agg(F.sum(F.col("pull") * F.col("value")).alias("g"))
        sent = self._vectors(weights, [name])

        def sums(batches):
            total = np.zeros(n)
            for batch in batches:
                y, found = _document_sums(batch, sent.value)
                idx, value, sizes = _term_lists(batch)
                total += np.bincount(idx, np.repeat(pull(y, found[0]), sizes) * value, n) if len(idx) else 0.0
            there = np.flatnonzero(total)
            for at in range(0, len(there), 100_000):
                part = there[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], ["idx", "g"])

        # Few tasks, each with much to add up before it sends its terms.
        parts = self.table.sparkSession.sparkContext.defaultParallelism
        rows = self.table.select("y", "idx", "value").coalesce(parts).mapInArrow(sums, "idx int, g double")
        return rows.groupBy("idx").agg(F.sum("g").alias("g"))


def _term_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False), sizes


def _document_sums(batch: pa.RecordBatch, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``y`` of the documents ``(y, idx, value)``, and their sums of value times each vector."""
    idx, value, sizes = _term_lists(batch)
    row = np.repeat(np.arange(len(sizes)), sizes)
    sums = [np.bincount(row, v[idx] * value, len(sizes)).astype(float) for v in vectors]
    return batch.column(0).to_numpy(zero_copy_only=False), sums


def term_rows(points: DataFrame, terms: DataFrame, id: str, max_bytes: int = DENSE_BYTES) -> TermRows:
    """Points ``(id, y, term, value)`` whose term is in ``terms`` as one stored row for each document."""
    number = F.col("idx").cast("int").alias("idx")
    numbered = written(dense_index(terms.select("term"), ["term"], "idx").select("term", number), "numbered-terms")
    n = numbered.count()
    known = lookup_join(points, numbered, "term").groupBy(id, "y")
    entries = F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))
    table = known.agg(F.array_sort(entries).alias("e")).select(id, "y", F.col("e.idx").alias("idx"), F.col("e.value").alias("value"))
    return TermRows(written(table, "documents"), numbered, n, id, n * 8 <= max_bytes)


def hinge_descent(
    points: DataFrame,
    terms: DataFrame,
    rows: int,
    id: str,
    iterations: int = 10,
    step: float = 0.1,
    reg: float = 0.01,
    tol: float = 1e-3,
    max_bytes: int = DENSE_BYTES,
) -> DataFrame:
    """``(term, weight)`` of a linear support vector machine, by full-batch descent on hinge loss.

    ``points`` is ``(id, y, term, value)``, one row for each feature of a document, ``y`` being 1 or -1;
    ``terms`` has the column ``term``, ``rows`` is the number of documents. The points are stored once as
    a row for each document (``TermRows``). A step is one pass over them: margins by document, and sums
    by term over the documents inside the margin; weights stay a table. It stops after the step, the
    second at the earliest, that moves them by less than ``tol`` of their length, or of 1.
    """
    documents = term_rows(points, terms, id, max_bytes)
    weights, stored = documents.terms.select("idx", F.lit(0.0).alias("weight")), None
    for t in range(1, iterations + 1):
        rate = step / math.sqrt(t)
        pull = documents.pulls(weights, "weight", lambda y, m: y * (np.round(y * m, 12) < 1))
        moved = F.col("weight") * (1 - rate * reg) + rate * F.coalesce("g", F.lit(0.0)) / rows
        found = weights.join(pull, "idx", "left").select("idx", moved.alias("weight"), F.col("weight").alias("last"))
        found = written(found, "weights")
        if stored is not None:
            forget(stored)
        weights, stored = found.select("idx", "weight"), found
        change = F.sum((F.col("weight") - F.col("last")) ** 2)
        moved, length = (math.sqrt(x or 0.0) for x in found.agg(change, F.sum(F.col("weight") ** 2)).first())
        if t > 1 and moved < tol * max(length, 1.0):
            break
    forget(documents.table)
    return documents.terms.join(weights, "idx").select("term", "weight")


def _token_points(docs: DataFrame, id: str, label: str, positive: str) -> tuple[DataFrame, DataFrame]:
    """Stored ``(id, y, tokens)`` with distinct tokens, and its points ``(id, y, term, value)``."""
    sign = F.when(F.col(label) == positive, 1.0).otherwise(-1.0).alias("y")
    signed = written(docs.select(id, sign, F.array_distinct("tokens").alias("tokens")), "signed-tokens")
    return signed, signed.select(id, "y", F.explode("tokens").alias("term"), F.lit(1.0).alias("value"))


def svm_sgd_fit(docs: DataFrame, spec: DataFrame, id: str, label: str, positive: str, **options) -> DataFrame:
    """``(term, doc_freq, weight)``: descent on the presence of the spec's terms in token lists."""
    signed, points = _token_points(docs, id, label, positive)
    weights = hinge_descent(points, spec, signed.count(), id, **options)
    return spec.join(weights, "term").select("term", "doc_freq", "weight")


def svm_fit(train: DataFrame, iterations: int = 10, reg: float = 0.01) -> np.ndarray:
    """The same objective by a quasi-Newton solver that reads the DataFrame itself."""
    model = LinearSVC(maxIter=iterations, regParam=reg, fitIntercept=False).fit(train)
    return model.coefficients.toArray()


def logistic_fit(train: DataFrame, num_classes: int = 2) -> LogisticRegressionModel:
    """Logistic regression by L-BFGS without penalty and without intercept."""
    family = "binomial" if num_classes == 2 else "multinomial"
    return LogisticRegression(
        family=family, maxIter=100, tol=1e-6, regParam=0.0, fitIntercept=False
    ).fit(train)


def logistic_l2_fit(train: DataFrame, c: float = 1.0, max_iter: int = 100) -> LogisticRegressionModel:
    """Logistic regression with penalty ``|w|^2 / 2`` against ``c`` times the summed loss.

    The learner averages the loss over the rows, hence ``1 / (c * rows)``.
    """
    rows = train.count()
    return LogisticRegression(
        family="binomial",
        regParam=1.0 / (c * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
    ).fit(train)


STEPS = [2.0**k for k in range(3, -8, -1)]  # lengths that a line search looks at
BIAS = ""  # the term that stands for the constant: no token is empty


def logistic_descent(
    points: DataFrame,
    terms: DataFrame,
    rows: int,
    id: str,
    l2: float = 0.0,
    iterations: int = 10,
    history: int = 4,
    tol: float = 1e-6,
    max_bytes: int = DENSE_BYTES,
) -> DataFrame:
    """``(term, weight)`` of a logistic regression, by L-BFGS whose vectors are term tables.

    ``points`` is ``(id, y, term, value)``, ``y`` being 1 or -1; ``terms`` has the column ``term``,
    ``rows`` is the number of documents. It minimises the mean loss plus ``l2 / 2`` times the squared
    weights, that of ``BIAS`` left out. The points are stored once as a row for each document.

    One table has for each term its weight, gradient and the last ``history`` steps and changes of the
    gradient. The two-loop recursion runs on the products of these columns with one another, which one
    aggregate adds up (Chen et al., 2014). A round passes twice over the documents (``TermRows``): once
    for the margins at the weights and along the direction, whose losses at all lengths of the line
    search are one aggregate, the best being taken; then for the sums of the residuals by term.
    """
    documents = term_rows(points, terms, id, max_bytes)

    def gradient(weights: DataFrame) -> DataFrame:
        """``(idx, g)`` of the loss at the weights ``w``."""
        sums = documents.pulls(weights, "w", lambda y, m: -y / (1 + np.exp(y * m)))
        return sums.select("idx", (F.col("g") / rows).alias("g"))

    bias = documents.terms.where(F.col("term") == BIAS).first()
    penalty = F.lit(l2) if bias is None else F.when(F.col("idx") == bias["idx"], 0.0).otherwise(l2)
    none = F.array().cast("array<double>")
    start = documents.terms.select("idx", F.lit(0.0).alias("w"))
    start = start.join(gradient(start), "idx", "left")
    state = written(start.select("idx", "w", F.coalesce("g", F.lit(0.0)).alias("g"), none.alias("s"), none.alias("c")), "descent")
    pairs = 0
    for _ in range(iterations):
        basis = [F.get("s", F.lit(j)) for j in range(pairs)] + [F.get("c", F.lit(j)) for j in range(pairs)] + [F.col("g")]
        at = [(a, b) for a in range(len(basis)) for b in range(a, len(basis))]
        found = state.agg(*[F.sum(basis[a] * basis[b]).alias(f"p{a}_{b}") for a, b in at], F.sum(F.col("w") ** 2).alias("w")).first()
        gram = np.zeros((len(basis), len(basis)))
        for a, b in at:
            gram[a, b] = gram[b, a] = found[f"p{a}_{b}"] or 0.0
        if math.sqrt(gram[-1, -1]) < tol * max(1.0, math.sqrt(found["w"] or 0.0)):
            break
        mixing = _two_loops(gram, pairs)
        direction = sum((F.lit(float(-x)) * b for x, b in zip(mixing, basis)), F.lit(0.0))
        last, state = state, written(state.withColumn("d", direction), "descent")
        forget(last)
        moves = documents.margins(state, ["w", "d"])
        losses = [F.sum(F.log1p(F.exp(-F.col("y") * (F.col("w") + t * F.col("d"))))).alias(f"l{k}") for k, t in enumerate(STEPS)]
        squares = [F.sum(penalty * (F.col("w") + t * F.col("d")) ** 2).alias(f"q{k}") for k, t in enumerate(STEPS)]
        loss, square = moves.agg(*losses).first(), state.agg(*squares).first()
        length = min(STEPS, key=lambda t: (loss[STEPS.index(t)] or 0.0) / rows + (square[STEPS.index(t)] or 0.0) / 2)
        moved = state.withColumns({"w": F.col("w") + length * F.col("d"), "step": length * F.col("d"), "before": F.col("g")}).drop("g", "d")
        moved = moved.join(gradient(moved), "idx", "left").withColumn("g", F.coalesce("g", F.lit(0.0)) + penalty * F.col("w"))
        first = 2 if pairs == history else 1
        kept = [F.concat(F.slice(c, first, history), F.array(x)).alias(c) for c, x in (("s", F.col("step")), ("c", F.col("g") - F.col("before")))]
        last, state = state, written(moved.select("idx", "w", "g", *kept), "descent")
        forget(last)
        pairs = min(pairs + 1, history)
    forget(documents.table)
    return documents.terms.join(state, "idx").select("term", F.col("w").alias("weight"))


def _two_loops(gram: np.ndarray, pairs: int) -> np.ndarray:
    """Shares of the steps, changes and gradient in the inverse Hessian times the gradient, by their products."""
    mixing = np.zeros(len(gram))
    mixing[-1] = 1.0
    alpha = np.zeros(pairs)
    for j in reversed(range(pairs)):
        alpha[j] = gram[j] @ mixing / gram[j, pairs + j]
        mixing[pairs + j] -= alpha[j]
    if pairs:
        mixing *= gram[pairs - 1, 2 * pairs - 1] / gram[2 * pairs - 1, 2 * pairs - 1]
    for j in range(pairs):
        mixing[j] += alpha[j] - gram[pairs + j] @ mixing / gram[j, pairs + j]
    return mixing


def logistic_terms_fit(
    docs: DataFrame, spec: DataFrame, id: str, label: str, positive: str, c: float | None = None, **options
) -> DataFrame:
    """``(term, doc_freq, weight)``: logistic regression on the presence of the spec's terms in token lists.

    Without ``c`` there is no penalty and no constant; with it, the penalty is ``|w|^2 / 2`` against ``c``
    times the summed loss, and the constant is the weight of ``BIAS``, whose document frequency is null.
    """
    signed, points = _token_points(docs, id, label, positive)
    terms, rows = spec.select("term", "doc_freq"), signed.count()
    if c is not None:
        points = points.unionByName(signed.select(id, "y", F.lit(BIAS).alias("term"), F.lit(1.0).alias("value")))
        terms = terms.unionByName(docs.sparkSession.createDataFrame([(BIAS, None)], "term string, doc_freq long"))
    terms = written(terms, "terms")
    l2 = 0.0 if c is None else 1.0 / (c * rows)
    weights = logistic_descent(points, terms, rows, id, l2, **options)
    return terms.join(weights, "term").select("term", "doc_freq", "weight")


def score_by_model(
    docs: DataFrame, weights: DataFrame, id: str, keep: list[str], tokens: str = "tokens"
) -> DataFrame:
    """``(id, keep..., margin)``: stored term weights applied to every document.

    A document without a known term has margin 0.
    """
    sums = document_sums(docs, weights, id, keep, {"margin": F.col("weight")}, tokens)
    return sums.select(id, *keep, F.round("margin", 9).alias("margin"))


def margin_class(margin: Column, positive: str = "positive", negative: str = "negative") -> Column:
    return F.when(margin > 0, positive).otherwise(negative)


# Logistic regression on table columns, with the coefficients' statistics

MAX_COLUMNS = 500


@dataclass(frozen=True)
class LogitModel:
    """Coefficients of a binomial model of table columns, and the inverse of their information matrix."""

    positive: str
    numeric: list[str]
    flags: list[tuple[str, str]]  # column and value of each 0/1 variable
    coefficients: np.ndarray  # of the numeric columns, of the flags, and the constant
    covariance: np.ndarray
    rounds: int

    def variables(self) -> list[str]:
        """Name of each coefficient: the column, or ``column=value`` of a 0/1 variable; last the constant."""
        return [*self.numeric, *[f"{c}={v}" for c, v in self.flags], "Constant"]

    def inputs(self) -> list[Column]:
        """One number for each coefficient; null where a cell that is needed is missing."""
        numbers = [F.col(c).cast("double") for c in self.numeric]
        return [*numbers, *[(F.col(c) == v).cast("double") for c, v in self.flags], F.lit(1.0)]

    def log_odds(self) -> Column:
        return sum((x * F.lit(float(w)) for x, w in zip(self.inputs(), self.coefficients)), F.lit(0.0))


def logit_fit(
    df: DataFrame,
    target: str,
    positive: str,
    columns: list[str] | None = None,
    max_rounds: int = 25,
    tol: float = 1e-8,
    max_columns: int = MAX_COLUMNS,
) -> LogitModel:
    """Logistic regression by iteratively reweighted least squares; ``positive`` is the class of the log odds.

    String columns become 0/1 variables against their first value in sorted order. A round is one pass over
    the rows: tasks add up weighted products of the variables, and their sums are added by Spark. What
    reaches the driver is one row with the upper half of the matrix of variables by variables, and the
    driver solves for the next coefficients; it stops when the deviance moves by less than ``tol`` of
    itself. Numbers are centred and scaled inside, so that the matrix is well-conditioned. Rows with a
    missing cell are left out. More than ``max_columns`` variables raise.
    """
    numeric, nominal = split_kinds(df, target)
    if columns:
        numeric = [c for c in numeric if c in columns]
        nominal = [c for c in nominal if c in columns]
    rows = df.select(*numeric, *nominal, target).dropna()
    values = small_rows(
        rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in nominal])).alias("x"))
        .select("x.c", "x.v").distinct(), max_columns, "values of nominal columns",
    ) if nominal else []
    flags = [(c, v) for c in nominal for v in sorted(r["v"] for r in values if r["c"] == c)[1:]]
    p = len(numeric) + len(flags) + 1
    if p > max_columns:
        raise ValueError(f"{p} variables, more than {max_columns}")
    model = LogitModel(positive, numeric, flags, np.zeros(p), np.zeros((p, p)), 0)
    shift, scale = np.zeros(p), np.ones(p)
    if numeric:
        cells = [F.col(c).cast("double") for c in numeric]
        found = rows.agg(*[F.avg(x) for x in cells], *[F.stddev_pop(x) for x in cells]).first()
        shift[: len(numeric)] = [x or 0.0 for x in found[: len(numeric)]]
        scale[: len(numeric)] = [x or 1.0 for x in found[len(numeric) :]]
    inputs = [(x - F.lit(float(a))) / F.lit(float(b)) for x, a, b in zip(model.inputs(), shift, scale)]
    known = (F.col(target) == positive).cast("double")
    points = written(rows.select(F.array(*inputs).alias("x"), known.alias("y")), "logit-points", even=True)

    beta, before, n = np.zeros(p), None, 0
    for n in range(1, max_rounds + 1):
        matrix, gradient, deviance = _weighted_products(points, beta)
        if before is not None and abs(deviance - before) < tol * (abs(deviance) + 0.1):
            break
        beta, before = beta + np.linalg.solve(matrix, gradient), deviance
    forget(points)
    # Back to the columns as they are: the constant takes up the centres.
    back = np.diag(1.0 / scale)
    back[-1, :] -= shift / scale
    covariance = back @ np.linalg.inv(matrix) @ back.T
    return replace(model, coefficients=back @ beta, covariance=covariance, rounds=n)


def _weighted_products(points: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Information matrix, gradient and deviance at ``beta``: one aggregate over all points."""
    p = len(beta)
    upper = np.triu_indices(p)

    def sums(batches):
        total = np.zeros(len(upper[0]) + p + 1)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, p)
            y = batch.column(1).to_numpy()
            odds = x @ beta
            chance = 1.0 / (1.0 + np.exp(-odds))
            weighted = x * (chance * (1.0 - chance))[:, None]
            loss = 2 * (np.logaddexp(0.0, odds) - y * odds).sum()
            total += np.concatenate([(x.T @ weighted)[upper], x.T @ (y - chance), [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "value"])

    found = points.mapInArrow(sums, "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))
    values = np.zeros(len(upper[0]) + p + 1)
    for r in found.collect():  # the upper half of a matrix of variables by variables
        values[r["i"]] = r["value"]
    matrix = np.zeros((p, p))
    matrix[upper] = values[: len(upper[0])]
    matrix = matrix + np.triu(matrix, 1).T
    return matrix, values[len(upper[0]) : -1], float(values[-1])


def logit_table(model: LogitModel, spark: SparkSession, positive: str) -> DataFrame:
    """``(logit, variable, coeff, std_err, z_score, p_value)``, one row for each coefficient."""
    errors = np.sqrt(np.diag(model.covariance))
    rows = []
    for name, c, e in zip(model.variables(), model.coefficients.tolist(), errors.tolist()):
        rows.append((positive, name, c, e, c / e, math.erfc(abs(c / e) / math.sqrt(2))))
    return spark.createDataFrame(
        rows, "logit string, variable string, coeff double, std_err double, z_score double, p_value double"
    )


def logit_predict(model: LogitModel, df: DataFrame, positive: str, negative: str, name: str) -> DataFrame:
    """The table with the predicted class as one more column (threshold 0.5); null where a cell is missing."""
    odds = model.log_odds()
    known = F.when(odds > 0, positive).when(odds.isNotNull(), negative)
    return df.withColumn(name, known)


# Kernel features


def _waves(width: int, sigma: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and shifts of the random Fourier features; every task draws the same ones from the seed."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / sigma, (width, n)), rng.uniform(0.0, 2 * math.pi, n)


def fourier_features(column: str | Column, width: int, sigma: float, n: int, seed: int) -> Column:
    """Random Fourier features (Rahimi and Recht, 2007) of ``exp(-|x - y|^2 / (2 sigma^2))``.

    Every task draws the same ``n`` waves from the seed; a batch is one matrix product.
    """

    @F.pandas_udf("array<double>")
    def waves(x: pd.Series) -> pd.Series:
        w, shift = _waves(width, sigma, n, seed)
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(math.sqrt(2.0 / n) * np.cos(np.stack(x) @ w + shift)))

    return waves(column)


WIDE_STEPS = [4.0**k for k in range(2, -13, -1)]  # along a gradient, whose length says little near a bend
ROWS_AT_ONCE = 4096  # rows whose kernel features are in memory at a time
ROWS_OF_FILE = 250_000  # rows of the learner that a task reads


@dataclass(frozen=True)
class KernelModel:
    """Weights of the kernel features, and the constant; the features come from ``width, sigma, n, seed``."""

    weights: np.ndarray  # of the features, and the constant
    width: int
    sigma: float
    n: int
    seed: int
    loss: float  # mean hinge loss and penalty at the weights
    passes: int

    def margin(self, cells: Column) -> Column:
        """The weighted features of a row, which never leave their task; null where a cell is missing."""

        @F.pandas_udf("double")
        def margins(x: pd.Series) -> pd.Series:
            waves, out = _waves(self.width, self.sigma, self.n, self.seed), np.zeros(len(x))
            for at in range(0, len(x), ROWS_AT_ONCE):
                out[at : at + ROWS_AT_ONCE] = _features(np.stack(x[at : at + ROWS_AT_ONCE]), *waves) @ self.weights
            return pd.Series(out)

        there = F.forall(cells, lambda v: v.isNotNull())
        return F.when(there, margins(F.transform(cells, lambda v: F.coalesce(v, F.lit(0.0)))))


def _features(x: np.ndarray, waves: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The kernel features of rows, and a 1 for the constant, in single precision.

    Phases are turned into the first period in double precision, so a feature is right to some 1e-7;
    its cosine is taken in single precision, which is twenty times as fast.
    """
    turns = x @ (waves / (2 * math.pi)) + shift / (2 * math.pi)
    turns -= np.rint(turns)
    z = np.ones((len(x), waves.shape[1] + 1), np.float32)
    z[:, :-1] = np.cos((turns * (2 * math.pi)).astype(np.float32))
    z[:, :-1] *= math.sqrt(2.0 / waves.shape[1])
    return z


def svm_rbf_fit(
    df: DataFrame,
    columns: list[str],
    label: str = "label",
    c: float = 1.0,
    sigma: float = 0.1,
    n: int = 128,
    seed: int = 42,
    iterations: int = 100,
    history: int = 10,
    tol: float = 1e-6,
) -> tuple[KernelModel, Column]:
    """Support vectors on kernel features. Returns ``(model, cells expression)``.

    ``c`` weighs the summed hinge loss against ``|w|^2 / 2``, the constant left out. Rows with a missing
    cell are left out. The cells are stored once; the features, ``n`` numbers for a row, are made anew in
    each pass and never stored. A pass is one aggregate over all rows: with the margins at the weights
    and along the direction (L-BFGS), each batch adds up loss and gradient for all lengths of the line
    search, so what reaches the driver is one gradient for each length.
    """
    cells = F.array(*[F.col(x).cast("double") for x in columns])
    known = df.select(cells.alias("x"), (2 * F.col(label) - 1).cast("double").alias("y"))
    known = known.where(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull())
    rows = known.count()
    # A pass is heavy for its bytes, so files are dealt out by rows.
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(max(cores, math.ceil(rows / ROWS_OF_FILE)), math.ceil(rows / ROWS_AT_ONCE))
    points = written(known.repartition(max(1, parts)), "kernel-points")
    model = KernelModel(np.zeros(n + 1), len(columns), sigma, n, seed, 0.0, 0)
    if not rows:
        forget(points)
        return model, cells
    penalty = np.append(np.full(n, 1.0 / (c * rows)), 0.0)

    def at_lengths(w: np.ndarray, d: np.ndarray, lengths: list[float]) -> tuple[np.ndarray, np.ndarray]:
        loss, gradient = _hinge_sums(points, model, w, d, lengths)
        at = w + np.array(lengths)[:, None] * d
        return loss / rows + (penalty * at**2).sum(1) / 2, gradient / rows + penalty * at

    w = model.weights
    losses, gradients = at_lengths(w, np.zeros(n + 1), [0.0])
    loss, gradient, pairs, passes = losses[0], gradients[0], [], 1
    while passes <= iterations and np.linalg.norm(gradient) > 0:
        basis = np.array([s for s, _ in pairs] + [g for _, g in pairs] + [gradient])
        direction = -(_two_loops(basis @ basis.T, len(pairs)) @ basis)
        lengths = STEPS if pairs else WIDE_STEPS
        losses, gradients = at_lengths(w, direction, lengths)
        passes += 1
        best = int(np.argmin(losses))
        gain = loss - losses[best]
        if gain > 0:
            moved, change = lengths[best] * direction, gradients[best] - gradient
            w, loss, gradient = w + moved, losses[best], gradients[best]
            if moved @ change > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(change):
                pairs = [*pairs, (moved, change)][-history:]
        if gain <= tol * abs(loss):
            if lengths is WIDE_STEPS:
                break
            pairs = []  # once more, from the gradient alone
    forget(points)
    return replace(model, weights=w, loss=float(loss), passes=passes), cells


def _hinge_sums(
    points: DataFrame, model: KernelModel, w: np.ndarray, d: np.ndarray, lengths: list[float]
) -> tuple[np.ndarray, np.ndarray]:
    """Summed hinge loss and its gradient at ``w`` and each length along ``d``: one aggregate over all points."""
    steps, p = np.array(lengths), len(w)
    at_weights = np.stack([w, d], axis=1).astype(np.float32)

    def sums(batches):
        waves, total = _waves(model.width, model.sigma, model.n, model.seed), np.zeros((p + 1, len(steps)))
        for batch in batches:
            cells = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, model.width)
            signs = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(signs), ROWS_AT_ONCE):
                z = _features(cells[at : at + ROWS_AT_ONCE], *waves)
                y = signs[at : at + ROWS_AT_ONCE, None]
                m, md = (z @ at_weights).astype(float).T
                inside = 1.0 - y * (m[:, None] + md[:, None] * steps)
                total[:-1] -= z.T @ (y * (inside > 0)).astype(np.float32)
                total[-1] += np.maximum(inside, 0.0).sum(0)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "value"])

    found = points.mapInArrow(sums, "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))
    values = np.zeros((p + 1) * len(steps))
    for r in found.collect():  # one gradient and loss for each length
        values[r["i"]] = r["value"]
    values = values.reshape(p + 1, len(steps))
    return values[-1], values[:-1].T


def svm_rbf_predict(model: KernelModel, cells: Column, df: DataFrame, classes: list[str], name: str) -> DataFrame:
    """The table with the predicted class as one more column; null where a cell is missing."""
    margin = model.margin(cells)
    return df.withColumn("_margin", margin).select(
        *df.columns, F.when(F.col("_margin") > 0, classes[1]).when(F.col("_margin").isNotNull(), classes[0]).alias(name)
    )


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """Numeric columns as one vector column."""
    wrong = [c for c, t in df.dtypes if c in columns and t not in NUMERIC]
    if wrong:
        raise TypeError(f"not numeric: {wrong}")
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)
