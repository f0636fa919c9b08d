"""Census-income lines: 15 comma-separated fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.functions.values import missing_token, safe_double, safe_int, trim_blanks

# Names and kinds of the 15 fields in the order of the file.
CENSUS = [
    ("age", "int"),
    ("workclass", "string"),
    ("fnlwgt", "int"),
    ("education", "string"),
    ("education_num", "int"),
    ("marital_status", "string"),
    ("occupation", "string"),
    ("relationship", "string"),
    ("race", "string"),
    ("sex", "string"),
    ("capital_gain", "double"),
    ("capital_loss", "double"),
    ("hours_per_week", "double"),
    ("native_country", "string"),
    ("label", "string"),
]
MISSING = "?"
# The loader empties the missing token in these fields only.
LOADER_EMPTIED = ("workclass", "occupation", "native_country")
# An unreadable number in these fields stops the loader.
LOADER_REQUIRED = ("capital_loss", "hours_per_week")


def read_census(spark: SparkSession, path: str, mode: str = "loader") -> DataFrame:
    """The 15 typed columns.

    ``loader``: unreadable whole numbers (and an unreadable capital gain) become null, ``?`` becomes
    empty in three columns, a short or blank line becomes a row of nulls, and an unreadable capital
    loss or number of hours stops the job.

    ``reader``: fields in single or double quotes, blanks trimmed, empty lines skipped, lines that have
    not 15 fields and unreadable numbers stop the job, all three money and hour columns are whole
    numbers, ``?`` is missing in every string column.
    """
    if mode == "loader":
        return parse_census(spark.read.text(path), "value")
    if mode != "reader":
        raise ValueError(f"unknown mode {mode!r}")
    return parse_quoted_census(spark.read.text(path), "value")


# A field up to its comma, in double quotes, in single quotes, or in none.
QUOTED_FIELD = r"""\s*("[^"]*"|'[^']*'|[^,]*?)\s*,"""


def parse_quoted_census(lines: DataFrame, column: str) -> DataFrame:
    """Reader rules on a column of lines; a comma inside either quote belongs to its field."""
    some = lines.where(F.trim(column) != "")
    fields = F.regexp_extract_all(F.concat(column, F.lit(",")), F.lit(QUOTED_FIELD), F.lit(1))
    cells = some.select(F.transform(fields, lambda x: F.regexp_replace(x, r"""^(["'])(.*)\1$""", "$2")).alias("p"))
    short = F.size("p") != len(CENSUS)
    columns = []
    for i, (name, kind) in enumerate(CENSUS):
        piece = F.nullif(F.get("p", F.lit(i)), F.lit(""))
        if kind == "string":
            value = F.nullif(piece, F.lit(MISSING))
        else:
            number = F.try_to_number(piece, F.lit("S999999999")).cast("int")
            bad = piece.isNotNull() & number.isNull()
            value = F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: "), piece))).otherwise(number)
        stop = F.raise_error(F.concat(F.lit("not 15 fields: "), F.concat_ws(",", "p")))
        columns.append(F.when(short, stop).otherwise(value).cast("string" if kind == "string" else "int").alias(name))
    return cells.select(*columns)


def parse_census(lines: DataFrame, column: str) -> DataFrame:
    """Loader rules on a column of lines. Empty pieces at the end of a line do not count."""
    pieces = F.split(F.regexp_replace(column, ",+$", ""), ",")
    cells = lines.select(F.transform(pieces, trim_blanks).alias("p"))
    whole = F.size("p") >= len(CENSUS)
    columns = []
    for i, (name, kind) in enumerate(CENSUS):
        piece = F.get("p", F.lit(i))
        if kind == "int":
            value = safe_int(piece)
        elif kind == "double":
            value = safe_double(piece)
            if name in LOADER_REQUIRED:
                bad = piece.isNotNull() & value.isNull()
                value = F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: "), piece))).otherwise(value)
        else:
            value = missing_token(piece, MISSING, "") if name in LOADER_EMPTIED else piece
        columns.append(F.when(whole, value).cast(kind).alias(name))
    return cells.select(*columns)
