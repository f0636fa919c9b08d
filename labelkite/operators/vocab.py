"""Vocabularies: by document frequency, or by significance for a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.operators.skew import dense_index, small_rows, top_k_per_group

MAX_CLASSES = 1000


def doc_freq(docs: DataFrame, tokens: str = "tokens", min_doc_freq: int = 2) -> DataFrame:
    """``(term, doc_freq)`` of the terms found in at least ``min_doc_freq`` documents.

    One row is one document: its repeats go inside the row, so that the count needs no distinct
    shuffle, and a term of every document costs one partial count by task.
    """
    terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("doc_freq")).where(
        F.col("doc_freq") >= min_doc_freq
    )


def class_sizes(docs: DataFrame, label: str = "label", max_classes: int = MAX_CLASSES) -> dict[str, int]:
    """Documents of each class, in class order; more than ``max_classes`` raise."""
    sizes = docs.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    rows = small_rows(sizes, max_classes, "classes")
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: r[0])}


def significant_terms(
    docs: DataFrame,
    tokens: str = "tokens",
    label: str = "label",
    size: int = 10_000,
    min_doc_count: int = 0,
) -> DataFrame:
    """``(label, rank, term, fg, bg, score)``: the terms that tell a class from all documents.

    ``fg`` and ``bg`` count documents with the term, in the class and in all. The score is
    ``(f - b) * f / b`` on their shares, kept where it is above 0. One pass counts both: the
    classes of a term are columns of one aggregate, not a second count and a join.
    """
    sizes = class_sizes(docs, label)
    classes, total = list(sizes), sum(sizes.values())
    terms = docs.where(F.col(label).isNotNull()).select(
        label, F.explode(F.array_distinct(tokens)).alias("term")
    )
    counts = terms.groupBy("term").agg(
        F.count("*").alias("bg"),
        *[F.count_if(F.col(label) == c).alias(f"_{i}") for i, c in enumerate(classes)],
    )
    by_class = counts.select(
        "term",
        "bg",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("label"),
                        F.col(f"_{i}").alias("fg"),
                        F.lit(float(sizes[c])).alias("_size"),
                    )
                    for i, c in enumerate(classes)
                ]
            )
        ),
    )
    f, b = F.col("fg") / F.col("_size"), F.col("bg") / F.lit(float(total))
    scored = by_class.withColumn("score", F.round((f - b) * f / b, 9)).where(
        (F.col("score") > 0) & (F.col("fg") >= min_doc_count)
    )
    best = top_k_per_group(scored, ["label"], [F.desc("score"), F.col("term")], size, ["term"])
    return best.select("label", "rank", "term", "fg", "bg", "score")


def assign_index(terms: DataFrame, term: str = "term") -> DataFrame:
    """Dense index 0..n-1 of each term, in term order."""
    return dense_index(terms, [term], "idx")


def vocabulary_spec(terms: DataFrame, spec_id: str) -> tuple[DataFrame, int]:
    """Feature spec ``(term, ..., idx, spec_id)`` and its length (the number of features)."""
    spec = assign_index(terms).withColumn("spec_id", F.lit(spec_id))
    return spec, spec.count()
