"""Chat rooms and issue threads: files that hold a JSON array.

Each reader is a scan of whole files, ``(path, value)``, and a parser over such rows, so that the same
rules serve files, archives and tables. The parsed fields stand beside the whole object, a VARIANT,
which keeps every other field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.functions.text import room_name

MESSAGE = {"message": "string", "from": "struct<name: string, user_id: string>"}
COMMENT = {"body": "string", "labels": "array<struct<name: string>>"}
NUMBERED_FILE = r"/(\d+)[^/]*$"
LARGE = 16 * 1024 * 1024  # bytes; no text below has more than a VARIANT or a JSON string can hold


def read_files(spark: SparkSession, root: str, suffix: str | None = None) -> DataFrame:
    """``(path, value)`` of every file below a folder, or of those whose name fits ``suffix``."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", suffix) if suffix else reader
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def fields_of(item: Column, fields: dict[str, str]) -> list[Column]:
    """Fields of a VARIANT object, null where it lacks them."""
    return [F.try_variant_get(item, f"$.{name}", kind).alias(name) for name, kind in fields.items()]


def parse_rooms(files: DataFrame, fields: dict[str, str] = MESSAGE) -> DataFrame:
    """One row by message of ``(path, value)`` rows: its fields, text, room and whole ``object``.

    The room is the file's folder without blanks and ``#``. A file that is not JSON is skipped, and
    so is a message without a text. An array that is too large for a VARIANT (128 MiB) stops the job; a
    room may be in any number of rows, so a large one can be given as several arrays.
    """
    # A line break inside a JSON string is not valid; as a blank it is.
    bodies = files.select("path", F.translate("value", "\n", " ").alias("value"))
    bodies = bodies.withColumn("body", F.try_parse_json("value"))
    # Only the parser of the VARIANT has the limit, so an array that has a length is JSON.
    large = F.col("body").isNull() & (F.octet_length("value") > LARGE)
    whole = F.when(large, F.json_array_length("value")).isNull()
    error = F.raise_error(F.concat(F.lit("too large for one row, give it as several arrays: "), "path"))
    items = F.when(whole, F.try_variant_get("body", "$", "array<variant>")).otherwise(error)
    rows = bodies.select(room_name("path").alias("room"), F.explode(items).alias("object"))
    parsed = rows.select(*fields_of(F.col("object"), fields), "room", "object")
    return parsed.withColumn("text", F.col("message")).where(F.col("message").isNotNull())


def read_rooms(
    spark: SparkSession, root: str, fields: dict[str, str] = MESSAGE, suffix: str = "*json"
) -> DataFrame:
    """``parse_rooms`` of every file below ``root`` whose name ends in ``json``."""
    return parse_rooms(read_files(spark, root, suffix), fields)


def parse_issue_threads(
    files: DataFrame, fields: dict[str, str] = COMMENT, number: str = NUMBERED_FILE
) -> DataFrame:
    """One row by comment: ``(thread, position, text, <comment fields>, object)``.

    A file is one thread, its last element is the opening issue, and its number is what ``number``
    finds in the path (by default the number that the file's name starts with). A file that is not
    JSON stops the job, as does one too large for a VARIANT (128 MiB). A large thread can be given in
    several rows, ``(path, first, value)``: ``first`` is the position of a row's first comment.
    """
    items = F.variant_get(F.parse_json("value"), "$", "array<variant>")
    first = F.col("first") if "first" in files.columns else F.lit(0)
    rows = files.select(
        F.regexp_extract("path", number, 1).cast("long").alias("thread"),
        first.cast("long").alias("first"),
        F.posexplode(items).alias("place", "object"),
    )
    return rows.select(
        "thread",
        (F.col("first") + F.col("place")).alias("position"),
        F.try_variant_get("object", "$.body", "string").alias("text"),
        *fields_of(F.col("object"), fields),
        "object",
    )


def read_issue_threads(
    spark: SparkSession, path: str, fields: dict[str, str] = COMMENT, number: str = NUMBERED_FILE
) -> DataFrame:
    """``parse_issue_threads`` of every file below a folder."""
    return parse_issue_threads(read_files(spark, path), fields, number)
