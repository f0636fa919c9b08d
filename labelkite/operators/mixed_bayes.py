"""Naive Bayes on table columns: Gaussian for numbers, counts for strings.

The learner's state is a mergeable aggregate, one pass for each kind of column. It is small by rule
(columns with more than ``max_nominal`` values are left out and listed), so predicting is a projection: no
join, no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelkite.operators.bayes import best_class
from labelkite.operators.prepare import NUMERIC
from labelkite.operators.rows import value_counts
from labelkite.operators.skew import small_rows
from labelkite.operators.vocab import MAX_CLASSES
from labelkite.shared import written

MAX_NOMINAL = 50


def split_kinds(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """Numeric and string columns of a table, without the class."""
    numeric = [c for c, t in df.dtypes if t in NUMERIC and c != target]
    return numeric, [c for c, t in df.dtypes if t == "string" and c != target]


def numeric_sums(df: DataFrame, target: str, numeric: list[str]) -> DataFrame:
    """``(class, rows, name, n, sum, square_sum, mean, std)`` over the non-missing cells, sample std.

    ``rows`` is the size of the class. Without numeric columns there is one row by class.
    """
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.sum(x).alias(f"s{i}"),
            F.sum(x * x).alias(f"q{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"d{i}"),
        ]
    by_class = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class"))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.col(f"n{i}").alias("n"),
                F.col(f"s{i}").alias("sum"),
                F.col(f"q{i}").alias("square_sum"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"d{i}").alias("std"),
            )
            for i, c in enumerate(numeric)
        ]
    )
    sums = by_class.agg(*aggregates)
    return sums.select("class", "rows", F.inline(cells)) if numeric else sums


def nominal_counts(
    df: DataFrame, target: str, nominal: list[str], max_nominal: int
) -> tuple[DataFrame, list[str]]:
    """``(class, name, value, n)`` of the columns with at most ``max_nominal`` values, and the others' names.

    The counts are stored: the check of the widths reads them again, not the table.
    """
    known = df.where(F.col(target).isNotNull()).withColumnRenamed(target, "class")
    counts = value_counts(known, nominal, ["class"]).where(F.col("value").isNotNull())
    counts = written(counts, "value-counts")
    widths = counts.select("name", "value").distinct().groupBy("name").agg(F.count("*").alias("values"))
    wide = small_rows(widths.where(F.col("values") > max_nominal), len(nominal), "columns")
    skipped = sorted(r["name"] for r in wide)
    kept = counts.where(~F.col("name").isin(skipped)) if skipped else counts
    return kept.select("class", "name", "value", "n"), skipped


def sufficient_stats(
    df: DataFrame, target: str, numeric: list[str], nominal: list[str], max_nominal: int = MAX_NOMINAL
) -> DataFrame:
    """Learner state ``(class, name, value, n, sum, square_sum)``; two of them can be added up."""
    numbers = numeric_sums(df, target, numeric).select(
        "class", "name", F.lit(None).cast("string").alias("value"), "n", "sum", "square_sum"
    )
    strings = nominal_counts(df, target, nominal, max_nominal)[0].withColumns(
        {"sum": F.lit(None).cast("double"), "square_sum": F.lit(None).cast("double")}
    )
    return numbers.unionByName(strings)


def share_of(target: str):
    """Window over the statistics rows that share one total: an attribute in a class, or all classes."""
    return Window.partitionBy(
        "attribute", F.when(F.col("attribute") != target, F.col("class"))
    )


@dataclass
class MixedBayes:
    """Fitted model; all parts are small and live on the driver."""

    target: str
    classes: dict[str, int]
    gauss: dict[str, dict[str, tuple[int, float, float]]]
    counts: dict[str, dict[str, dict[str, int]]]
    threshold: float = 0.0
    skipped: list[str] = field(default_factory=list)

    def statistics(self, spark) -> DataFrame:
        """``(attribute, value, class, count, mean, std)``, zero counts included.

        A column that was skipped for its many values has one row without a class.
        """
        rows = [(name, None, None, None, None, None) for name in self.skipped]
        for name, by_class in self.gauss.items():
            rows += [(name, None, c, *by_class.get(c, (0, None, None))) for c in self.classes]
        for name, by_value in self.counts.items():
            for value, by_class in by_value.items():
                rows += [(name, value, c, by_class.get(c, 0), None, None) for c in self.classes]
        rows += [(self.target, None, c, n, None, None) for c, n in self.classes.items()]
        return spark.createDataFrame(
            rows,
            "attribute string, value string, class string, count long, mean double, std double",
        )

    @classmethod
    def from_statistics(cls, table: DataFrame, target: str, threshold: float = 0.0) -> "MixedBayes":
        classes, gauss, counts, skipped = {}, {}, {}, []
        for r in table.collect():
            if r["class"] is None:
                skipped.append(r["attribute"])
            elif r["attribute"] == target:
                classes[r["class"]] = r["count"]
            elif r["value"] is None:
                gauss.setdefault(r["attribute"], {})[r["class"]] = (r["count"], r["mean"], r["std"])
            else:
                by_value = counts.setdefault(r["attribute"], {})
                by_value.setdefault(r["value"], {})[r["class"]] = r["count"]
        return cls(target, dict(sorted(classes.items())), gauss, counts, threshold, sorted(skipped))

    def _floor(self, p: float) -> float:
        p = max(p, self.threshold)
        return math.log(p) if p > 0 else -math.inf

    def _gauss_log(self, name: str, label: str) -> Column:
        n, mean, std = self.gauss[name].get(label, (0, None, None))
        x = F.col(name).cast("double")
        if not n:
            part = F.lit(self._floor(0.0))
        elif not std:
            part = F.when(x == mean, 0.0).otherwise(F.lit(self._floor(0.0)))
        else:
            z = (x - mean) / std
            part = F.lit(-math.log(std * math.sqrt(2 * math.pi))) - z * z / 2
            if self.threshold > 0:
                part = F.greatest(part, F.lit(math.log(self.threshold)))
        return F.when(x.isNull(), 0.0).otherwise(part)

    def _count_logs(self, name: str) -> Column:
        """Log probability of the cell's value in each class, by one lookup."""
        by_value, classes = self.counts[name], list(self.classes)
        totals = [sum(by_class.get(c, 0) for by_class in by_value.values()) for c in classes]

        def logs(by_class):
            shares = [by_class.get(c, 0) / t if t else 0.0 for c, t in zip(classes, totals)]
            return F.array(*[F.lit(self._floor(p)) for p in shares])

        table = F.create_map(*[x for v, by_class in by_value.items() for x in (F.lit(v), logs(by_class))])
        found = F.coalesce(F.try_element_at(table, F.col(name)), logs({}))
        return F.when(F.col(name).isNull(), F.array(*[F.lit(0.0)] * len(classes))).otherwise(found)

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """One more column with the class; where all classes score zero, the most frequent one.

        A missing cell is skipped. An unseen value has probability 0 (or the threshold).
        """
        total = sum(self.classes.values())
        looked_up = df.withColumns({f"_log{j}": self._count_logs(c) for j, c in enumerate(self.counts)})
        scores = {}
        for i, (label, n) in enumerate(self.classes.items()):
            score = F.lit(math.log(n / total))
            for c in self.gauss:
                score = score + self._gauss_log(c, label)
            for j in range(len(self.counts)):
                score = score + F.get(F.col(f"_log{j}"), F.lit(i))
            scores[f"_score{i}"] = F.round(score, 9)
        names = list(scores)
        prior = min(self.classes, key=lambda c: (-self.classes[c], c))
        top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        best = F.when(top == F.lit(-math.inf), F.lit(prior)).otherwise(
            best_class(list(self.classes), names)
        )
        return looked_up.withColumns(scores).select(*df.columns, best.alias(name))


def mixed_fit(
    df: DataFrame,
    target: str,
    numeric: list[str] | None = None,
    nominal: list[str] | None = None,
    threshold: float = 0.0,
    max_nominal: int = MAX_NOMINAL,
) -> MixedBayes:
    """Fit on all columns but the class, or on the given ones.

    String columns with more than ``max_nominal`` values are left out and listed in ``skipped``.
    """
    kinds = split_kinds(df, target)
    numeric = kinds[0] if numeric is None else numeric
    nominal = kinds[1] if nominal is None else nominal
    classes: dict = {}
    gauss: dict = {c: {} for c in numeric}
    counts: dict = {}
    skipped: list[str] = []
    limit = MAX_CLASSES * max(1, len(numeric))
    for r in small_rows(numeric_sums(df, target, numeric), limit, "class statistics"):
        classes[r["class"]] = r["rows"]
        if numeric:
            gauss[r["name"]][r["class"]] = (r["n"], r["mean"], r["std"])
    if nominal:
        limit = len(nominal) * max_nominal * len(classes)
        kept, skipped = nominal_counts(df, target, nominal, max_nominal)
        rows = small_rows(kept, limit, "value counts")
        for r in sorted(rows, key=lambda r: (r["name"], r["value"], r["class"])):
            counts.setdefault(r["name"], {}).setdefault(r["value"], {})[r["class"]] = r["n"]
    return MixedBayes(target, dict(sorted(classes.items())), gauss, counts, threshold, skipped)
