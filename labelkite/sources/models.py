"""Fitted models as parameter tables, stored under a model id and the id of their feature spec."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.operators.bayes import TermBayes
from labelkite.operators.linear import LogitModel
from labelkite.operators.mixed_bayes import MixedBayes
from labelkite.operators.prepare import ImputeModel, RangeModel
from labelkite.operators.tree import TreeModel

SCHEMAS = {
    "term_bayes_classes": {"label": "string", "docs": "bigint", "total": "double", "smoothing": "double"},
    "term_weights": {"term": "string", "doc_freq": "bigint", "weight": "double"},
    "table_bayes": {
        "attribute": "string",
        "value": "string",
        "class": "string",
        "count": "bigint",
        "mean": "double",
        "std": "double",
    },
    "impute": {"name": "string", "kind": "string", "value": "string"},
    "logit": {
        "place": "int",
        "column": "string",
        "value": "string",
        "coefficient": "double",
        "covariance": "array<double>",
        "positive": "string",
    },
    "tree_columns": {"place": "int", "column": "string", "kind": "string"},
    "ranges": {"name": "string", "low": "double", "high": "double", "lo": "double", "hi": "double"},
}


def _folder(root: str, kind: str, model_id: str, spec_id: str) -> str:
    return f"{root}/{kind}/model_id={model_id}/spec_id={spec_id}"


def write_parameters(df: DataFrame, root: str, kind: str, model_id: str, spec_id: str = "none") -> None:
    """Replace one model's parameters of one kind."""
    df.write.mode("overwrite").parquet(_folder(root, kind, model_id, spec_id))


def load_parameters(
    spark: SparkSession, root: str, kind: str, model_id: str, spec_id: str = "none"
) -> DataFrame:
    """One model's parameters; raises where a column is missing or has another type."""
    df = spark.read.parquet(_folder(root, kind, model_id, spec_id))
    found = dict(df.dtypes)
    wrong = {c: t for c, t in SCHEMAS.get(kind, {}).items() if found.get(c) != t}
    if wrong:
        raise ValueError(f"stored {kind} of {model_id!r} lacks {wrong}")
    return df


def write_model(model, root: str, model_id: str, spec_id: str = "none") -> None:
    """Store a fitted model of this library; ML models are stored with their own writer."""
    if isinstance(model, TermBayes):
        spark = model.counts.sparkSession
        classes = model.class_table().withColumn("smoothing", F.lit(model.smoothing))
        write_parameters(classes, root, "term_bayes_classes", model_id, spec_id)
        write_parameters(model.counts, root, "term_bayes_counts", model_id, spec_id)
    elif isinstance(model, MixedBayes):
        spark = SparkSession.active()
        write_parameters(model.statistics(spark), root, "table_bayes", model_id, spec_id)
    elif isinstance(model, ImputeModel):
        write_parameters(model.table(SparkSession.active()), root, "impute", model_id, spec_id)
    elif isinstance(model, RangeModel):
        write_parameters(model.table(SparkSession.active()), root, "ranges", model_id, spec_id)
    elif isinstance(model, LogitModel):
        names = [*[(c, None) for c in model.numeric], *model.flags, (None, None)]
        cells = zip(range(len(names)), names, model.coefficients.tolist(), model.covariance.tolist())
        table = [(i, c, v, w, row, model.positive) for i, (c, v), w, row in cells]
        schema = ", ".join(f"{c} {t}" for c, t in SCHEMAS["logit"].items())
        write_parameters(SparkSession.active().createDataFrame(table, schema), root, "logit", model_id, spec_id)
    elif isinstance(model, TreeModel):
        write_parameters(model.nodes, root, "tree", model_id, spec_id)
        named = [(c, "number") for c in model.numeric] + [(c, "value") for c in model.nominal]
        named += [(model.label, "label"), (model.prediction, "prediction"), (str(model.depth), "depth")]
        rows = [(i, c, kind) for i, (c, kind) in enumerate(named)]
        schema = ", ".join(f"{c} {t}" for c, t in SCHEMAS["tree_columns"].items())
        write_parameters(SparkSession.active().createDataFrame(rows, schema), root, "tree_columns", model_id, spec_id)
    else:
        model.write().overwrite().save(_folder(root, "ml", model_id, spec_id))


def load_term_bayes(spark: SparkSession, root: str, model_id: str, spec_id: str) -> TermBayes:
    rows = sorted(load_parameters(spark, root, "term_bayes_classes", model_id, spec_id).collect())
    counts = load_parameters(spark, root, "term_bayes_counts", model_id, spec_id)
    model = TermBayes(
        [r["label"] for r in rows],
        [r["docs"] for r in rows],
        [r["total"] for r in rows],
        counts.count(),
        rows[0]["smoothing"],
        counts,
    )
    if any(not math.isclose(a, r["prior"]) for a, r in zip(model.priors(), rows)):
        raise ValueError(f"stored priors of {model_id!r} do not fit its counts")
    return model


def load_table_bayes(
    spark: SparkSession, root: str, model_id: str, target: str, spec_id: str = "none"
) -> MixedBayes:
    return MixedBayes.from_statistics(
        load_parameters(spark, root, "table_bayes", model_id, spec_id), target
    )


def load_impute(spark: SparkSession, root: str, model_id: str, spec_id: str = "none") -> ImputeModel:
    return ImputeModel.from_table(load_parameters(spark, root, "impute", model_id, spec_id))


def load_ranges(spark: SparkSession, root: str, model_id: str, spec_id: str = "none") -> RangeModel:
    return RangeModel.from_table(load_parameters(spark, root, "ranges", model_id, spec_id))


def load_logit(spark: SparkSession, root: str, model_id: str, spec_id: str = "none") -> LogitModel:
    rows = sorted(load_parameters(spark, root, "logit", model_id, spec_id).collect(), key=lambda r: r["place"])
    return LogitModel(
        rows[0]["positive"],
        [r["column"] for r in rows if r["value"] is None and r["column"] is not None],
        [(r["column"], r["value"]) for r in rows if r["value"] is not None],
        np.array([r["coefficient"] for r in rows]),
        np.array([r["covariance"] for r in rows]),
        0,
    )


def load_tree(spark: SparkSession, root: str, model_id: str, spec_id: str = "none") -> TreeModel:
    rows = sorted(load_parameters(spark, root, "tree_columns", model_id, spec_id).collect(), key=lambda r: r["place"])
    by_kind = {k: [r["column"] for r in rows if r["kind"] == k] for k in ("number", "value", "label", "prediction", "depth")}
    nodes = load_parameters(spark, root, "tree", model_id, spec_id)
    label, prediction, depth = (by_kind[k][0] for k in ("label", "prediction", "depth"))
    return TreeModel(nodes, label, by_kind["number"], by_kind["value"], int(depth), prediction)


def load_ml_model(kind, root: str, model_id: str, spec_id: str = "none"):
    """A model stored by its own writer; ``kind`` is its class."""
    return kind.load(_folder(root, "ml", model_id, spec_id))
