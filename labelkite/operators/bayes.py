"""Multinomial naive Bayes on terms: aggregates, and a lookup of each document's terms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.operators.vectors import document_sums, occurrences
from labelkite.operators.vocab import class_sizes
from labelkite.shared import written


def best_class(classes: list[str], scores: list[str]) -> Column:
    """Class whose score column is the largest; ties go to the smaller class."""
    top = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    found = F.lit(classes[-1])
    for c, s in zip(classes[-2::-1], scores[-2::-1]):
        found = F.when(F.col(s) == top, F.lit(c)).otherwise(found)
    return found


@dataclass
class TermBayes:
    """A fitted model.

    ``counts``: stored table ``(term, doc_freq, n_0, n_1, ...)`` with the weight of the term in each
    class, one row for each vocabulary term. The rest has one number for each class.
    """

    classes: list[str]
    docs: list[int]
    totals: list[float]
    length: int
    smoothing: float
    counts: DataFrame

    def priors(self) -> list[float]:
        n, k = sum(self.docs), len(self.classes)
        return [math.log((d + self.smoothing) / (n + k * self.smoothing)) for d in self.docs]

    def bases(self) -> list[float]:
        """Log of the denominator that all terms of a class share."""
        return [math.log(t + self.smoothing * self.length) for t in self.totals]

    def weights(self) -> DataFrame:
        """``(term, label, count, weight)``: smoothed log probability of each term in each class."""
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("label"),
                    F.col(f"n_{i}").alias("count"),
                    (F.log(F.col(f"n_{i}") + self.smoothing) - base).alias("weight"),
                )
                for i, (c, base) in enumerate(zip(self.classes, self.bases()))
            ]
        )
        return self.counts.select("term", F.inline(cells))

    def class_table(self) -> DataFrame:
        rows = list(zip(self.classes, self.docs, self.totals, self.priors()))
        return self.counts.sparkSession.createDataFrame(
            rows, "label string, docs long, total double, prior double"
        )


def multinomial_fit(
    docs: DataFrame,
    vocabulary: DataFrame,
    label: str = "label",
    tokens: str = "tokens",
    smoothing: float = 1.0,
) -> TermBayes:
    """Fit on 0/1 occurrences of the vocabulary's terms.

    ``docs`` are the training documents, ``vocabulary`` the stored ``(term, doc_freq)`` table. The
    terms are counted first, and only one row by term meets the vocabulary: no term is hot in the
    join.
    """
    sizes = class_sizes(docs, label)
    classes = list(sizes)
    counted = occurrences(docs, [label], tokens).groupBy("term").agg(
        *[F.count_if(F.col(label) == c).alias(f"n_{i}") for i, c in enumerate(classes)]
    )
    names = [f"n_{i}" for i in range(len(classes))]
    counts = written(
        vocabulary.select("term", "doc_freq")
        .join(counted, "term", "left")
        .select("term", "doc_freq", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in names]),
        "term-counts",
    )
    length, *totals = counts.agg(F.count("*"), *[F.sum(n) for n in names]).first()
    return TermBayes(
        classes, list(sizes.values()), [t or 0.0 for t in totals], length, smoothing, counts
    )


def multinomial_predict(
    model: TermBayes, docs: DataFrame, id: str, keep: list[str], tokens: str = "tokens"
) -> DataFrame:
    """``(id, keep..., predicted, score)`` for every document, also one without known terms.

    With ``n`` known terms in the document, the score of a class is
    ``prior - n * base + sum(log(count + smoothing))``: absent terms need no rows.
    """
    k = range(len(model.classes))
    logs = {f"_s{i}": F.log(F.col(f"n_{i}") + model.smoothing) for i in k}
    sums = document_sums(docs, model.counts, id, keep, logs, tokens)
    priors, bases = model.priors(), model.bases()
    names = [f"_score{i}" for i in k]
    scored = sums.withColumns(
        {
            names[i]: F.round(F.lit(priors[i]) + F.col(f"_s{i}") - F.col("_n") * F.lit(bases[i]), 9)
            for i in k
        }
    )
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return scored.select(
        id, *keep, best_class(model.classes, names).alias("predicted"), top.alias("score")
    )


def predicted_field(
    df: DataFrame, model: TermBayes, id: str, text_tokens: Column, name: str = "predicted"
) -> DataFrame:
    """The rows with the predicted class as one more field."""
    predictions = multinomial_predict(model, df.select(id, text_tokens.alias("tokens")), id, [])
    return df.join(predictions.select(id, F.col("predicted").alias(name)), id)
