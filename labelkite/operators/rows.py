"""Projections, filters, splits, unions and samples of rows."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.functions.values import unit_hash


def project_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the chosen fields."""
    return df.select(*names)


def keep_columns(
    df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Column filter of a learner: the included columns in their order, less the excluded ones."""
    exclude = set(exclude or [])
    return df.select(*[c for c in (include or df.columns) if c not in exclude])


def exclude_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """Drop rows with any of the flags true; a row without the flag stays."""
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def drop_empty_vectors(df: DataFrame, tokens: str = "tokens", keep_empty: bool = False) -> DataFrame:
    """Leave out documents without features; ``keep_empty`` keeps them as all-zero vectors."""
    return df if keep_empty else df.where(F.size(tokens) > 0)


def hash_split(
    df: DataFrame, weights: list[float], keys: list[str], seed: int = 42
) -> list[DataFrame]:
    """Split rows at random by weight.

    The place of a row depends on its key alone, so both parts agree however often they are
    computed, and the split is a plain filter below all later work.
    """
    total = float(sum(weights))
    ends = [w / total for w in accumulate(weights)]
    u = unit_hash(*keys, seed=seed)
    return [
        df.where((u >= low) & (u < high)) for low, high in zip([0.0] + ends[:-1], ends[:-1] + [1.0])
    ]


def random_scan(
    df: DataFrame, keys: list[str], min_score: float = 0.999, seed: int = 42
) -> DataFrame:
    """Give every row a random score and keep those that reach ``min_score``."""
    return df.withColumn("score", unit_hash(*keys, seed=seed)).where(F.col("score") >= min_score)


def sample_rows(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows by ``order``, for a look at the data."""
    return df.orderBy(*order).limit(n)


def union_labelled(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, matched by column name, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def count_documents(df: DataFrame) -> DataFrame:
    """Number of rows as one row."""
    return df.agg(F.count("*").alias("total"))


def profile(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """Domain of each column: ``(name, type, lower, upper, n_values, missing)``.

    Numbers have bounds, strings the number of their values; ``column_values`` has the values
    themselves. One pass for the numbers (a one-row result) and one for the strings, which counts
    each (column, value) before the shuffle, so a value that fills its column costs one row by task.
    """
    types = dict(df.dtypes)
    parts = []
    if numeric:
        low_high = df.agg(
            *[F.min(c).cast("double").alias(f"lo_{c}") for c in numeric],
            *[F.max(c).cast("double").alias(f"hi_{c}") for c in numeric],
            *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in numeric],
        )
        cells = [
            F.struct(
                F.lit(c).alias("name"),
                F.lit(types[c]).alias("type"),
                F.col(f"lo_{c}").alias("lower"),
                F.col(f"hi_{c}").alias("upper"),
                F.lit(None).cast("long").alias("n_values"),
                F.col(f"na_{c}").alias("missing"),
            )
            for c in numeric
        ]
        parts.append(low_high.select(F.inline(F.array(*cells))))
    if nominal:
        widths = value_counts(df, nominal).groupBy("name").agg(
            F.lit("string").alias("type"),
            F.lit(None).cast("double").alias("lower"),
            F.lit(None).cast("double").alias("upper"),
            F.count("value").alias("n_values"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        )
        parts.append(widths)
    return reduce(DataFrame.unionByName, parts)


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, value, n)``: every value of each column and its rows, however many there are."""
    return value_counts(df, columns).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of each (column, value), and of each group where ``by`` is given."""
    by = by or []
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(*by, F.inline(cells)).groupBy(*by, "name", "value").agg(F.count("*").alias("n"))
    )
