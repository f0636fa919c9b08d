import pytest
from pyspark.sql import functions as F

from labelkite.operators import sketches


def read(frame):
    return {r["name"]: r for r in frame.collect()}


def test_parts_say_what_the_whole_says(spark):
    """Many values, few values, gaps; batches of unlike sizes, one of them empty."""
    df = spark.range(30_000).selectExpr(
        "id", "CASE WHEN id % 10 > 0 THEN id % 7000 / 2.0 END AS x", "concat('v', id % 20000) AS s", "CAST(NULL AS string) AS none"
    )
    batches = [df.where("id < 100"), df.where("id BETWEEN 100 AND 20000"), df.where("id > 20000"), df.where("id < 0")]
    parts = [sketches.column_sketches(b, ["x"], ["s", "none"]) for b in batches]
    shares = [0.1, 0.5, 0.9]
    got = read(sketches.estimates(sketches.united(parts), shares))
    whole = read(sketches.estimates(sketches.united([sketches.column_sketches(df, ["x"], ["s", "none"])]), shares))
    exact = df.selectExpr("count(x) n", "min(x) lo", "max(x) hi", "count(DISTINCT x) d").first()
    assert (got["x"]["n"], got["x"]["missing"], got["x"]["lower"], got["x"]["upper"]) == (exact["n"], 3000, exact["lo"], exact["hi"])
    assert got["x"]["n_values"] == pytest.approx(exact["d"], rel=0.03) and got["s"]["n_values"] == pytest.approx(20_000, rel=0.03)
    assert (got["none"]["n"], got["none"]["missing"], got["none"]["n_values"], got["none"]["at"]) == (0, 30_000, 0, None)
    assert all(got[c]["n_values"] == whole[c]["n_values"] for c in got)
    for share, at in zip(shares, got["x"]["at"]):
        below = df.where(F.col("x") <= at).count() / exact["n"]
        assert below == pytest.approx(share, abs=0.02)
    one = read(sketches.column_sketches(df, ["x"], ["s"]))
    assert len(one["s"]["distinct"]) < 20_000 and len(one["x"]["quantiles"]) < 20_000
