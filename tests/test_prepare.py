import pytest
from pyspark.sql import functions as F

from labelkite.operators import prepare, rows as row_ops


def table(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", "x"), (2, None, "b", None), (3, 4.0, None, "x"), (None, 7.0, "b", "y"), (5, 8.0, "a", None)],
        "k int, v double, s string, u string",
    )


def test_impute_rules(spark):
    df = table(spark)
    entries = [(["v"], ("none",)), (["v"], ("mean",)), (["v"], ("fixed", 99.0)), (["s"], ("most_frequent",))]
    rules = prepare.resolve_rules(
        entries, dict(df.dtypes), {"int": ("fixed", 0), "string": ("fixed", "other")}
    )
    assert rules == {
        "v": ("mean",), "s": ("most_frequent",), "k": ("fixed", 0), "u": ("fixed", "other")
    }
    model = prepare.impute_fit(df, rules)
    # a and b occur twice each: the smaller value fills.
    assert model.fills == {"k": 0, "v": 5.0, "s": "a", "u": "other"}
    got = [tuple(r) for r in model.apply(df).collect()]
    assert got[1] == (2, 5.0, "b", "other") and got[2][2] == "a" and got[3][0] == 0
    assert prepare.ImputeModel.from_table(model.table(spark)).fills == model.fills


def test_most_frequent_number(spark):
    df = spark.createDataFrame([(10, 2.5), (9, 10.0), (10, 2.5), (9, 10.0), (None, 1.0)], "i int, d double")
    model = prepare.impute_fit(df, {"i": ("most_frequent",), "d": ("most_frequent",)})
    assert model.fills == {"i": 9, "d": 2.5}
    assert model.apply(df).dtypes == df.dtypes
    empty = df.where("i > 100")
    assert prepare.impute(empty, {"i": ("mean",), "d": ("most_frequent",)}).count() == 0


def test_one_hot(spark):
    df = table(spark)
    got = prepare.one_hot(df, ["s", "u"])
    assert got.columns == ["k", "v", "s", "u", "a_s", "b_s", "x_u", "y_u"]
    assert tuple(got.collect()[1])[4:] == (0, 1, 0, 0)
    assert prepare.one_hot(df, ["s"], keep_source=False).columns == ["k", "v", "u", "a_s", "b_s"]
    with pytest.raises(ValueError):
        prepare.one_hot(df, ["s"], max_values=1)


def test_min_max(spark):
    df = table(spark).withColumn("c", F.lit(3))
    model = prepare.min_max_fit(df, ["v", "c"])
    got = [(r["v"], r["c"]) for r in model.apply(df).collect()]
    assert got[0] == (-1.0, -1.0) and got[1] == (None, -1.0) and got[4][0] == 1.0
    more = spark.createDataFrame([(15.0, 3)], "v double, c int")
    assert prepare.RangeModel.from_table(model.table(spark)).apply(more).first()["v"] == pytest.approx(3.0)


def test_profile(spark):
    got = {r["name"]: r for r in row_ops.profile(table(spark), ["k", "v"], ["s", "u"]).collect()}
    assert (got["k"]["lower"], got["k"]["upper"], got["k"]["missing"]) == (1.0, 5.0, 1)
    assert (got["s"]["n_values"], got["s"]["missing"]) == (2, 1)
    assert (got["u"]["n_values"], got["u"]["missing"]) == (2, 2)
    values = row_ops.column_values(table(spark), ["s", "u"])
    assert {r["value"] for r in values.where("name = 's'").collect()} == {"a", "b"}
    wide = spark.range(70).selectExpr("concat('v', id) AS s")
    assert row_ops.profile(wide, [], ["s"]).first()["n_values"] == row_ops.column_values(wide, ["s"]).count() == 70
    assert row_ops.profile(table(spark), ["k"], []).first()["upper"] == 5.0
