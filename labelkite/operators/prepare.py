"""Table columns before learning: fill missing cells, one-hot, scale to a range.

Each step is fitted in one aggregate whose result has one value by column, and applied as plain
column expressions, so that applying never joins or shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.operators.rows import value_counts
from labelkite.operators.skew import small_rows

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
MAX_VALUES = 50


def resolve_rules(
    entries: list[tuple[list[str], tuple]], columns: dict[str, str], type_defaults: dict[str, tuple]
) -> dict[str, tuple]:
    """The rule of each column.

    Rules are ``('mean',)``, ``('fixed', value)``, ``('most_frequent',)`` and ``('none',)``. Where
    a column has several entries, the first that does something wins; a column without one gets
    the default of its type (``'int'``, ``'double'``, ``'string'``), or none.
    """
    rules: dict[str, tuple] = {}
    for names, rule in entries:
        for name in names:
            if name in columns and rules.get(name, ("none",)) == ("none",):
                rules[name] = rule
    kinds = {"bigint": "int", "smallint": "int", "tinyint": "int", "float": "double"}
    for name, dtype in columns.items():
        if name not in rules:
            rules[name] = type_defaults.get(kinds.get(dtype, dtype), ("none",))
    return rules


@dataclass
class ImputeModel:
    """The value that fills each column."""

    fills: dict[str, object] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fills.items() if c in df.columns}
        )

    def table(self, spark) -> DataFrame:
        """``(name, kind, value)`` rows, as stored with a model."""
        rows = [(c, type(v).__name__, str(v)) for c, v in sorted(self.fills.items())]
        return spark.createDataFrame(rows, "name string, kind string, value string")

    @classmethod
    def from_table(cls, table: DataFrame) -> "ImputeModel":
        kinds = {"int": int, "float": float, "str": str}
        return cls({r["name"]: kinds[r["kind"]](r["value"]) for r in table.collect()})


def impute_fit(df: DataFrame, rules: dict[str, tuple]) -> ImputeModel:
    """Fit the filling values: all means in one aggregate, all most frequent values in another.

    Most frequent: the largest count, ties to the smaller value (numbers by size). Values are counted before the
    shuffle, so one that fills its column is cheap.
    """
    fills: dict[str, object] = {c: r[1] for c, r in rules.items() if r[0] == "fixed"}
    means = [c for c, r in rules.items() if r[0] == "mean"]
    if means:
        row = df.agg(*[F.avg(c).alias(c) for c in means]).first()
        fills.update({c: row[c] for c in means if row[c] is not None})
    modes = [c for c, r in rules.items() if r[0] == "most_frequent"]
    if modes:
        types = dict(df.dtypes)
        numbers = [c for c in modes if types[c] in NUMERIC]
        counts = value_counts(df, modes).where(F.col("value").isNotNull())
        size = F.when(F.col("name").isin(numbers), F.col("value").try_cast("double"))
        best = counts.groupBy("name").agg(
            F.min(F.struct(-F.col("n"), size.alias("size"), F.col("value"))).alias("b")
        )
        for r in best.select("name", "b.size", "b.value").collect():
            whole = types[r["name"]] in NUMERIC[:4]
            fills[r["name"]] = r["value"] if r["size"] is None else int(r["value"]) if whole else r["size"]
    return ImputeModel({c: fills[c] for c in df.columns if c in fills})


def impute(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    return impute_fit(df, rules).apply(df)


def nominal_values(df: DataFrame, columns: list[str], max_values: int = MAX_VALUES) -> dict:
    """Sorted values of each column; a column with more than ``max_values`` is an error."""
    found = value_counts(df, columns).where(F.col("value").isNotNull()).select("name", "value")
    rows = small_rows(found, max_values * len(columns), f"values in {columns}")
    values = {c: sorted(r["value"] for r in rows if r["name"] == c) for c in columns}
    wide = [c for c in columns if len(values[c]) > max_values]
    if wide:
        raise ValueError(f"more than {max_values} values in {wide}")
    return values


def one_hot(
    df: DataFrame,
    columns: list[str],
    values: dict[str, list[str]] | None = None,
    keep_source: bool = True,
    max_values: int = MAX_VALUES,
) -> DataFrame:
    """One 0/1 column ``<value>_<column>`` for each value of each column."""
    values = values or nominal_values(df, columns, max_values)
    flags = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(f"{v}_{c}") for c in columns for v in values[c]
    ]
    kept = [c for c in df.columns if keep_source or c not in columns]
    return df.select(*kept, *flags)


@dataclass
class RangeModel:
    """Lower and upper bound of each column, and the range to scale to."""

    bounds: dict[str, tuple[float, float]]
    lo: float = -1.0
    hi: float = 1.0

    def column(self, name: str) -> Column:
        """Scaled column; a constant one becomes ``lo``, values outside the bounds are not cut."""
        low, high = self.bounds[name]
        if high == low:
            return F.when(F.col(name).isNotNull(), F.lit(self.lo))
        x = F.col(name).cast("double")
        return F.lit(self.lo) + (x - low) / F.lit(high - low) * F.lit(self.hi - self.lo)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.bounds if c in df.columns})

    def table(self, spark) -> DataFrame:
        rows = [(c, a, b, self.lo, self.hi) for c, (a, b) in self.bounds.items()]
        return spark.createDataFrame(
            rows, "name string, low double, high double, lo double, hi double"
        )

    @classmethod
    def from_table(cls, table: DataFrame) -> "RangeModel":
        rows = table.collect()
        return cls({r["name"]: (r["low"], r["high"]) for r in rows}, rows[0]["lo"], rows[0]["hi"])


def min_max_fit(df: DataFrame, columns: list[str], lo: float = -1.0, hi: float = 1.0) -> RangeModel:
    """Bounds of all columns in one aggregate; a column without any value is left alone."""
    row = df.agg(
        *[F.min(c).cast("double").alias(f"l_{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("double").alias(f"h_{i}") for i, c in enumerate(columns)],
    ).first()
    bounds = {c: (row[f"l_{i}"], row[f"h_{i}"]) for i, c in enumerate(columns)}
    return RangeModel({c: b for c, b in bounds.items() if b[0] is not None}, lo, hi)


def min_max(df: DataFrame, columns: list[str], lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    return min_max_fit(df, columns, lo, hi).apply(df)
