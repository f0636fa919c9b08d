"""Connected components of links, by rounds of joins; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.tables import join_groups
from labelkite.shared import forget, written

ROUNDS = 100
FILE_ROWS = 1 << 14  # links worth a file and a task


def _with_least(edges: DataFrame, files: int) -> DataFrame:
    """Edges with ``least``, the smallest of vertex ``a`` and its neighbours; a hot vertex is broadcast."""
    sums = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("least"), F.count("*").alias("degree"))
    return join_groups(edges, written(sums, "least", files=files), "a", "degree")


def _large_star(edges: DataFrame, files: int) -> DataFrame:
    """Each larger neighbour is linked to the smallest vertex around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, files).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame, files: int) -> DataFrame:
    """Each smaller neighbour, and the vertex itself, is linked to the smallest of them."""
    joined = _with_least(edges, files)
    near = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = joined.select("a", F.col("least").alias("b"))
    return near.unionByName(own).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(vertex, component)`` of all vertices of links ``(a, b)``; a component's id is its smallest.

    Large and small stars by turns, until a round changes nothing. Each round is stored, which cuts
    the lineage, in as few files as its links are worth; the number of rounds grows with the logarithm
    of the longest chain.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(links.select(a, b).where("a != b").distinct(), "links")
    files = -(-edges.count() // FILE_ROWS)
    before = None
    for _ in range(ROUNDS):
        large = written(_large_star(edges, files), "links", files=files)
        last, edges = edges, written(_small_star(large, files), "links", files=files)
        forget(last)
        forget(large)
        sums = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = edges.agg(F.count("*"), sums).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    others = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    smallest = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return others.unionByName(smallest.coalesce(max(1, files)))
