"""Labelled text: one file by document in a folder by label, and polarity CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.functions.text import blank_text, clean_text
from labelkite.functions.values import trim_blanks
from labelkite.operators.rows import union_labelled
from labelkite.operators.skew import dense_index
from labelkite.sources.messages import read_files


def labelled_texts(files: DataFrame) -> DataFrame:
    """``(label, text)`` of ``(label, value)`` rows, each a whole file."""
    return files.select("label", blank_text("value").alias("text"))


def read_labelled_dirs(spark: SparkSession, folders: dict[str, str | list[str]]) -> DataFrame:
    """``(label, text)``: every file of a folder is one document of the folder's label."""
    parts = [
        spark.read.text(paths, wholetext=True).select(F.lit(label).alias("label"), "value")
        for label, paths in folders.items()
    ]
    return labelled_texts(union_labelled(parts))


def number_files(files: DataFrame, classes: list[str]) -> DataFrame:
    """``(id, text, class, path)`` of ``(class, path, value)`` rows, a path being unique in its class.

    Ids run from 1 over the classes in the given order, and by path inside a class. Only class and
    path are sorted, not the texts.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    numbered = dense_index(files.select("class", "path", place.alias("_place")), ["_place", "path"], "id", start=1)
    text = clean_text("value").alias("text")
    return files.join(numbered.drop("_place"), ["class", "path"]).select("id", text, "class", "path")


def read_sequential_docs(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """``number_files`` of all files below each class's folder."""
    parts = [
        read_files(spark, path).select(F.lit(name).alias("class"), "path", "value") for name, path in folders.items()
    ]
    return number_files(union_labelled(parts), list(folders))


# The columns of the polarity file, and the code of a positive text.
POLARITY_COLUMNS = ["polarity", "tweet_id", "date", "query", "user", "text"]
POSITIVE = "4"


def read_polarity_csv(spark: SparkSession, path: str, mode: str = "naive") -> DataFrame:
    """``(label, text)`` of six-column polarity lines.

    ``naive`` splits each line at every comma, so that the text ends at its first comma and keeps
    its opening quote; a line without a sixth piece has an empty text. ``csv`` reads quoted fields.
    """
    if mode == "naive":
        pieces = F.split("value", ",")
        is_positive = trim_blanks(F.get(pieces, 0)) == f'"{POSITIVE}"'
        text = F.coalesce(trim_blanks(F.get(pieces, 5)), F.lit(""))
        lines = spark.read.text(path)
    elif mode == "csv":
        schema = ", ".join(f"{c} string" for c in POLARITY_COLUMNS)
        lines = spark.read.csv(path, schema=schema, quote='"', escape='"')
        is_positive, text = F.col("polarity") == POSITIVE, F.coalesce("text", F.lit(""))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    label = F.when(is_positive, "positive").otherwise("negative")
    return lines.select(label.alias("label"), text.alias("text"))
