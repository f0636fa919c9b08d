"""Joins of documents with what was found out about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_GROUPS = 4096


def shards(df: DataFrame) -> int:
    """Number of shuffle partitions of the session: set it so that a partition fits in a task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    while name in df.columns:
        name = f"_{name}"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` to the stored table ``groups``, unique on ``key``.

    ``size`` is the number of rows of a group. A group above 1/4096 of all rows is hot; there can be
    at most 4096 of those, so they are broadcast and their rows are not shuffled. Of the other groups
    none is large, so their rows are joined by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = total / HOT_GROUPS
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    settled = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return settled.unionByName(rest)


def only(docs: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """The documents whose id is in the one column of ``ids``; a null id matches a null."""
    name = free_name(docs, "wanted")
    return docs.join(ids.toDF(name), F.col(id).eqNullSafe(F.col(name)), "left_semi")
