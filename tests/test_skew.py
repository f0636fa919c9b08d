import pytest
from pyspark.sql import functions as F

from labelkite.operators.skew import dense_index, lookup_join, small_rows, top_k_per_group
from labelkite.shared import written


@pytest.mark.parametrize("max_bytes", [10**9, 40_000, 400])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_hot_keys(spark, rows, max_bytes, how):
    """A third of the rows has a known key, a sixth an unknown one, a tenth none; all ways give the plain join."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 6 == 1, "unknown").when(F.col("id") % 10 == 2, None)
    big = spark.range(6000).select("id", key.otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("key"))
    table = big.where("key is not null and key not in ('k5', 'unknown')").groupBy("key").agg(F.count("*").alias("n"))
    table = written(table.withColumn("value", F.repeat("key", 5)), "lookup")
    got = lookup_join(big, table, "key", how, max_bytes=max_bytes)
    want = big.join(table, "key", how)
    columns = ["id", "key", "n", "value"]
    assert rows(got, *columns) == rows(want, *columns)


@pytest.mark.parametrize("width", [5, 3000])
def test_lookup_join_spreads_hot_keys(spark, width):
    """Of a known and an unknown hot key, no row is in the shuffle by key; wide values are not broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "unknown")
        big = written(spark.range(40000).select(
            "id", key.otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key")
        ), "rows")
        table = big.where("key != 'unknown'").groupBy("key").agg(F.count("*").alias("n"))
        table = written(table.withColumn("value", F.repeat(F.lit("x"), width)), "lookup")
        got = lookup_join(big, table, "key", "left", max_bytes=2000).select("id", "n", "value")
        assert got.where("n is null").count() == 13333
        sizes = [r["c"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
        assert sum(sizes) == 40000 and max(sizes) < 13000
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == (1 if width == 5 else 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k_per_group(spark, rows):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 37 % 101).alias("s"))
    got = top_k_per_group(df, ["g"], [F.desc("s"), F.col("id")], 7, ["id"], salts=5)
    data = [(i % 2, -(i * 37 % 101), i) for i in range(500)]
    want = []
    for g in (0, 1):
        best = sorted(d for d in data if d[0] == g)[:7]
        want += [(g, rank, d[2]) for rank, d in enumerate(best, 1)]
    assert rows(got, "g", "rank", "id") == sorted(want, key=repr)


def test_dense_index(spark):
    df = spark.range(1000).select(F.concat(F.lit("t"), F.col("id")).alias("term")).repartition(7)
    got = {r["term"]: r["idx"] for r in dense_index(df, ["term"], start=1).collect()}
    assert got == {t: i for i, t in enumerate(sorted(f"t{n}" for n in range(1000)), 1)}


def test_small_rows_raises_instead_of_cutting(spark):
    assert len(small_rows(spark.range(3), 3, "rows")) == 3
    with pytest.raises(ValueError):
        small_rows(spark.range(4), 3, "rows")
