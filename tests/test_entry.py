import re
from pathlib import Path

import __spark_entry__ as entry
import pytest
from check_sql import compare, connect

from labelkite.plans import inputs
from labelkite.sources import tables
from places import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "label", "predicted", "score"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, SMALL, name)
    assert result.startswith("equal"), result


def shuffled(spark, df):
    """Columns of each shuffle in the plan."""
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan, re.M)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_texts_are_scored_where_they_are_read(spark, threshold):
    """Only ids and fields pass the shuffles of the prediction, whether labels are sent to all tasks or not."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        passed = shuffled(spark, entry.queries()["predicted_field"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert passed and not any("text#" in x or "tokens#" in x for x in passed)


def test_labels_meet_texts_without_a_growing_task(spark, rows, monkeypatch):
    """Small labels go to the texts; for larger ones a task of the join gets a share of the texts that does not grow."""
    path = f"{SMALL}/documents.parquet"
    assert tables.join_parts(spark, path) is None  # the session's number is enough
    assert tables.join_parts(spark, path, Path(path).stat().st_size // 9) in (9, 10)
    monkeypatch.setattr(inputs, "join_parts", lambda spark, path: 9)
    monkeypatch.setattr(inputs, "documents", lambda spark, sf: inputs.table(spark, sf, "documents", ["doc_id", "text"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent, dealt = inputs.labelled(spark, SMALL), inputs.labelled(spark, SMALL, max_bytes=0)
        assert shuffled(spark, sent) == []
        parts = re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\)", dealt._jdf.queryExecution().executedPlan().toString())
        assert parts and set(parts) == {"9"}
        assert rows(sent, "doc_id", "label", "text") == rows(dealt, "doc_id", "label", "text") != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compared_models_have_their_own_accuracy(spark):
    """Two of the three figures follow from queries that SQL confirms."""
    q = entry.queries()
    got = {r["model"]: (r["accuracy"], r["n"]) for r in q["compare_models"](spark, SMALL).collect()}
    naive = q["accuracy"](spark, SMALL).first()
    svm = q["svm_predict"](spark, SMALL).selectExpr(
        "avg(cast(label = predicted as double)) a", "count(*) n"
    ).first()
    assert got["naive_bayes"] == (pytest.approx(naive["accuracy"], abs=1e-9), naive["n"])
    assert got["svm"] == (pytest.approx(svm["a"]), svm["n"])
    assert got["logistic"][1] == naive["n"]


@pytest.mark.parametrize("name", ["lr_predict", "lr_l2_predict", "logit_predict", "tree_predict"])
def test_learners_return_one_class_by_row(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.where("predicted is null").count() == 0
    table = "lineitem" if name in ("logit_predict", "tree_predict") else None
    if table:
        assert df.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
