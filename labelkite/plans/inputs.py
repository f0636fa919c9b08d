"""The given tables in the shapes that the operators read, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.functions import tokenize
from labelkite.operators.rows import hash_split
from labelkite.operators.skew import BROADCAST_BYTES, table_bytes
from labelkite.operators.vocab import doc_freq
from labelkite.shared import TEXT_PARTS, written
from labelkite.sources.tables import join_parts, read_documents, spread

CLASSES = ["negative", "positive"]
WEIGHTS = [6, 4]
SEED = 42


def table(spark: SparkSession, sf: str, name: str, fields: list[str] | None = None) -> DataFrame:
    return read_documents(spark, f"{sf}/{name}.parquet", fields)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and texts, dealt out to as many tasks as the session's setting says.

    Without the setting they stay as the files have them, which is right for many files. A single file
    with one row group is one task's work, however many cores there are.
    """
    parts = spark.conf.get(TEXT_PARTS, None)
    return spread(table(spark, sf, "documents", ["doc_id", "text"]), int(parts) if parts else None)


def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tokenize("text").alias("tokens"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("quality") == 1, "positive").otherwise("negative")
    return table(spark, sf, "labels", ["doc_id", "quality"]).select("doc_id", label.alias("label"))


def labelled(spark: SparkSession, sf: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, text, label)``; both sides have one row by document.

    Labels of up to ``max_bytes`` are sent to all tasks, and texts stay where they are read. Larger ones decide, by
    the number of their parts, among how many tasks the texts are dealt.
    """
    docs, named = documents(spark, sf), labels(spark, sf)
    if table_bytes(named)[1] <= max_bytes:
        return docs.join(F.broadcast(named), "doc_id")
    parts = join_parts(spark, f"{sf}/documents.parquet")
    return docs.join(named.repartition(parts, "doc_id") if parts else named, "doc_id")


def split_tokens(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Training and test part ``(doc_id, label, tokens)``; the split is below the tokenizing."""
    parts = hash_split(labelled(spark, sf), WEIGHTS, ["doc_id"], SEED)
    return [p.select("doc_id", "label", tokenize("text").alias("tokens")) for p in parts]


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Stored ``(term, doc_freq)`` of all documents."""
    return written(doc_freq(document_tokens(spark, sf)), "vocabulary")


def order_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer and nation: the table with a class (``o_orderstatus``)."""
    fields = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    orders = table(spark, sf, "orders", fields)
    customer = table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = table(spark, sf, "nation", ["n_nationkey", "n_name"])
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )


# The same as SQL

CLEAN = "regexp_replace(translate({c}, chr(10) || '\"\\', '   '), '[^\\x20-\\x7E]', '', 'g')"


def clean_sql(c: str) -> str:
    return CLEAN.format(c=c)


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(lower({clean_sql(c)}), '[a-z0-9]+')"


def unit_sql(key: str) -> str:
    return f"(CAST('0x' || substr(md5('{SEED}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0)"


LABELS = """lab AS (
  SELECT doc_id, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS label FROM labels
)"""

TERMS = f"""tok AS (
  SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS term FROM documents
),
vocab AS (SELECT term, count(*) AS doc_freq FROM tok GROUP BY term HAVING count(*) >= 2)"""

SPLIT = f"""{LABELS},
part AS (SELECT doc_id, label, {unit_sql('doc_id')} < 0.6 AS train FROM lab)"""

ORDER_TABLE = """t AS (
  SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
