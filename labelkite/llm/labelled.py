"""The labelled rows that a classifier may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
MOST_CHARS = 200_000  # longer texts are scored, but by default not learned from


def held_out(id: str) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text, 0 modulo 5. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % FOLDS == 0


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    id: str = "doc_id",
    text: str = "text",
    most_chars: int | None = MOST_CHARS,
) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``per_class`` learning rows of each label.

    The rows with the smallest hash of their id, so the same ones each time. Only their ids, at most
    twice ``per_class``, are sent to all tasks. A document with labels of both kinds is left out, and so
    is a text of more than ``most_chars`` characters, if that is given: what a learner holds is bounded by
    both numbers.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(id))
        .groupBy(F.col(id).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).alias("_most"))
        .where("label = _most")
        .select("doc_id", "label")
    )
    chosen = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    if most_chars is not None:
        rows = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars)
    return rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
