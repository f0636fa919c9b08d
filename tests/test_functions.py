from pyspark.sql import functions as F

from labelkite.functions import (
    clean_text,
    encode_label,
    join_tokens,
    missing_token,
    room_name,
    safe_double,
    safe_int,
    tokenize,
    trim_blanks,
    unit_hash,
)


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, clean_text("t"), t='a\nb"c\\d\té\x7fe~') == "a b c de~"


def test_tokens(spark):
    # A documented pair of text and tokens.
    assert one(spark, tokenize("t"), t="Yeah! It has Spark!") == ["yeah", "it", "has", "spark"]
    assert one(spark, tokenize("t"), t="Green-eyed cats, 3 OF them") == ["green", "eyed", "cats", "3", "of", "them"]


def test_tokenize_equals_its_definition(spark):
    text = "".join(chr(c) for c in [*range(1, 256), 0x130, 0x212A, 0x1F600]) + ' X\tY\nZ "q\\r" É1 '
    pattern = F.regexp_extract_all(F.lower(clean_text("t")), F.lit("[a-z0-9]+"), F.lit(0))
    assert one(spark, tokenize("t"), t=text * 3) == one(spark, pattern, t=text * 3)
    assert one(spark, tokenize("t"), t="...") == []
    assert one(spark, tokenize("t"), t="") == []


def test_join_tokens(spark):
    assert one(spark, join_tokens(tokenize("t")), t="A b!") == " a b"
    assert one(spark, join_tokens(tokenize("t")), t="!") == ""


def test_numbers(spark):
    assert one(spark, safe_int(F.col("t")), t="+5") == 5
    assert one(spark, safe_int(F.col("t")), t="5.0") is None
    assert one(spark, safe_int(F.col("t")), t="99999999999") is None
    assert one(spark, safe_double(F.col("t")), t="1e3") == 1000.0
    assert one(spark, safe_double(F.col("t")), t="x") is None


def test_labels_and_missing(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("other",)], "l string")
    got = df.select("l", encode_label(F.col("l")).alias("a"), encode_label(F.col("l"), "negative").alias("b"))
    assert [tuple(r) for r in got.collect()] == [
        ("positive", 1.0, 1.0), ("negative", 0.0, 0.0), ("other", 0.0, 1.0)
    ]
    assert one(spark, missing_token(F.col("t")), t="?") is None
    assert one(spark, missing_token(F.col("t"), fill=""), t="?") == ""
    assert one(spark, missing_token(F.col("t"), fill=""), t="x") == "x"
    assert one(spark, trim_blanks("t"), t="\t x \x01") == "x"


def test_room_name(spark):
    assert one(spark, room_name("t"), t="file:/a/%23Big%20Room/2015.json") == "BigRoom"


def test_unit_hash_is_even_and_repeatable(spark):
    df = spark.range(20000).select(unit_hash("id").alias("u"), unit_hash("id", seed=7).alias("v"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "v")).first()
    assert 0 <= row[0] < 0.001 and 0.999 < row[1] < 1
    assert abs(row[2] - 0.5) < 0.01 and abs(row[3]) < 0.03
