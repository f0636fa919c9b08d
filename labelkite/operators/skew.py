"""Joins, top-k and numbering that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelkite.shared import written

BROADCAST_BYTES = 32 * 1024 * 1024
HOT_SHARE = 512


def table_bytes(table: DataFrame, columns: list[str] | None = None) -> tuple[int, int]:
    """Number of rows and bytes of a table's cells, as measured."""
    cells = F.octet_length(F.to_json(F.struct(*(columns or table.columns))))
    n, total = table.agg(F.count("*"), F.sum(cells.cast("long"))).first()
    return n, total or 0


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` to ``table``, which is unique on ``key``, without a hot partition.

    ``table`` should be a stored table, as its cells are measured first. One that fits in ``max_bytes``
    is broadcast. With a larger one, the keys that have more than 1/512 of the rows are hot, whether
    the table knows them or not; there are at most 512. Their rows never enter the shuffle by key: they
    meet the hot keys' values by a broadcast, or, if those values are too wide for it, by a join on key
    and salt, to which each hot key comes once for each salt. All other rows are joined by a shuffle in
    which no key is hot. Rows without a key have no partner.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join {how!r}")
    if table_bytes(table)[1] <= max_bytes:
        return rows.join(F.broadcast(table), key, how)

    counts = written(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > total / HOT_SHARE).select(key)
    values = [c for c in table.columns if c != key]
    found = (F.struct(*values) if values else F.struct(F.lit(1).alias("_there"))).alias("_found")
    hot = written(hot.join(table.select(key, found), key, "left"), "hot-keys")
    others = [c for c in rows.columns if c != key]
    out = [key, *others, *[F.col("_found")[v].alias(v) for v in values]]

    if table_bytes(hot)[1] <= max_bytes:
        settled = rows.join(F.broadcast(hot), key)
    else:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SHARE))
        each = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOT_SHARE - 1).cast("long"))))
        only_hot = rows.join(F.broadcast(hot.select(key)), key, "left_semi")
        settled = only_hot.withColumn("_salt", salt).join(each, [key, "_salt"])
    settled = settled.where(F.col("_found").isNotNull()) if how == "inner" else settled
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").where(F.col(key).isNotNull())
    rest = cold.join(table, key, how)
    parts = settled.select(*out).unionByName(rest.select(key, *others, *values))
    if how == "left":
        nothing = [F.lit(None).cast(t).alias(c) for c, t in table.dtypes if c != key]
        parts = parts.unionByName(rows.where(F.col(key).isNull()).select(key, *others, *nothing))
    return parts


def top_k_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    k: int,
    spread: list[str],
    rank: str = "rank",
    salts: int | None = None,
) -> DataFrame:
    """First ``k`` rows of each group by ``order``, numbered from 1.

    Two rounds: at most ``k`` rows of each (group, salt), then of each group. The last round gets
    at most ``salts * k`` rows of a group, however large the group is. By default there are as many
    salts as shuffle partitions.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    near = (
        salted.withColumn(
            "_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
        )
        .where(F.col("_r") <= k)
        .drop("_r", "_salt")
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    return near.withColumn(rank, place).where(F.col(rank) <= k)


def dense_index(df: DataFrame, order: list, name: str = "idx", start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in the given total order.

    Range-partitioned sort, then an offset for each partition: no task sees more than its range.
    The sorted table is stored, so that a recomputed partition cannot shift the numbers. Only the
    partition sizes (one row each) pass through the closing window.
    """
    sorted_rows = df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id())
    stored = written(sorted_rows, "ordered")
    part = F.shiftright("_pos", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.col("_pos").bitwiseAND((1 << 33) - 1)
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + inside + start).cast("long"))
        .drop("_part", "_pos", "_offset")
    )


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must be small; raises above ``limit`` rows instead of cutting it."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows
