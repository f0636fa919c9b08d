"""Counts of predictions: buckets, accuracy, confusion matrix, class statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelkite.operators.skew import top_k_per_group
from labelkite.shared import written


def top_terms(df: DataFrame, field: str, size: int = 10) -> DataFrame:
    """The ``size`` most frequent values of a field, ties by value."""
    counts = df.groupBy(field).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), field).limit(size)


def nested_terms(df: DataFrame, outer: str, inner: str, size: int = 10) -> DataFrame:
    """The ``size`` most frequent ``outer`` values, and inside each the ``size`` inner ones.

    The pair counts are stored, as both rounds read them.
    """
    counts = written(df.groupBy(outer, inner).agg(F.count("*").alias("n")), "pair-counts")
    buckets = (
        counts.groupBy(outer)
        .agg(F.sum("n").alias("bucket"))
        .orderBy(F.desc("bucket"), outer)
        .limit(size)
    )
    inside = counts.join(F.broadcast(buckets), outer)  # at most ``size`` rows
    return top_k_per_group(inside, [outer], [F.desc("n"), F.col(inner)], size, [inner])


def accuracy(df: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    """Share of right predictions, in one job."""
    right = F.col(actual) == F.col(predicted)
    return df.agg(F.avg(right.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(actual, predicted, n)``; rows with a missing value on either side are left out."""
    return (
        df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row for each actual class, one column ``p_<class>`` for each predicted one, zeros filled.

    Each row of the data gives a count to its own cell; the grid rows add the empty classes. A
    predicted class that is not among ``classes`` stops the job.
    """
    counts = confusion_counts(df, actual, predicted)
    unknown = F.col("predicted").isNotNull() & ~F.col("predicted").isin(*classes)
    stop = F.raise_error(F.concat(F.lit("unknown class: "), F.col("predicted").cast("string")))
    counts = counts.withColumn("n", F.when(unknown, stop.cast("long")).otherwise(F.col("n")))
    grid = df.sparkSession.createDataFrame([(c,) for c in classes], "actual string").withColumns(
        {"predicted": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}
    )
    cells = [
        F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(f"p_{c}")
        for c in classes
    ]
    return counts.unionByName(grid).groupBy("actual").agg(*cells)


def _class_sums(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(class, tp, fp, fn, n)``: each pair count goes to its actual and its predicted class."""
    counts = confusion_counts(df, actual, predicted)
    same, n, none = F.col("actual") == F.col("predicted"), F.col("n"), F.lit(0).cast("long")
    right, wrong = F.when(same, n).otherwise(none), F.when(same, none).otherwise(n)

    def role(name, tp, fp, fn, rows):
        return F.struct(
            F.col(name).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), rows.alias("n")
        )

    roles = F.array(role("actual", right, none, wrong, n), role("predicted", none, wrong, none, none))
    sums = counts.select(F.inline(roles)).groupBy("class")
    return sums.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n")])


def class_statistics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row for each class and an overall row (class null): 11 figures as in a scorer's table.

    The sums, one row for each class, are stored: both parts of the result read them, and the
    predictions are computed once.
    """
    sums = written(_class_sums(df, actual, predicted), "class-sums")
    every = Window.partitionBy(F.lit(0))
    sums = sums.withColumn("all", F.sum("n").over(every)).withColumn(
        "tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")
    )

    def ratio(a, b):
        return F.try_divide(a.cast("double"), b.cast("double"))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    per_class = sums.select(
        "class", "tp", "fp", "tn", "fn",
        recall.alias("recall"),
        precision.alias("precision"),
        recall.alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(2 * precision * recall, precision + recall).alias("f_measure"),
        F.lit(None).cast("double").alias("accuracy"),
        F.lit(None).cast("double").alias("kappa"),
    )
    overall = _totals(sums)
    missing = {
        c: F.lit(None).cast(t) for c, t in per_class.dtypes if c not in ("accuracy", "kappa")
    }
    return per_class.unionByName(overall.select("accuracy", "kappa").withColumns(missing))


def _totals(sums: DataFrame) -> DataFrame:
    """Overall figures from the sums by class."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = sums.agg(
        F.sum("tp").alias("correct"),
        F.sum("n").alias("_n"),
        F.sum((tp + fn).cast("double") * (tp + fp)).alias("_chance"),
    )
    share = F.col("correct") / F.col("_n")
    chance = F.col("_chance") / (F.col("_n").cast("double") * F.col("_n"))
    return one.select(
        share.alias("accuracy"),
        (F.lit(1.0) - share).alias("error"),
        "correct",
        (F.col("_n") - F.col("correct")).alias("false"),
        F.try_divide(share - chance, F.lit(1.0) - chance).alias("kappa"),
    )


def scorer_totals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``accuracy, error, correct, false, kappa`` as one row."""
    return _totals(_class_sums(df, actual, predicted))


def compare_accuracy(predictions: dict[str, DataFrame], actual: str, predicted: str) -> DataFrame:
    """``(model, accuracy, n)`` of several models on the same test part."""
    return reduce(
        DataFrame.unionByName,
        [
            accuracy(df, actual, predicted).select(F.lit(name).alias("model"), "accuracy", "n")
            for name, df in predictions.items()
        ],
    )
