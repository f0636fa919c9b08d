"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a stored table, and returns documents with the columns
of ``documents``; the last returns the pieces of the packed sequences with their token ids. Any folder
of tables has ``documents``, ``labels`` and ``benchmark``.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.llm import decontaminate, exact_dedup, jaccard_join, packing, quality_crf
from labelkite.shared import written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
WORDS, SIMILARITY = 5, Fraction(8, 10)  # of near duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learned from the labels of these documents, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.good_documents(docs, quality_crf.fit(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of those with equal texts."""
    return exact_dedup.deduplicate(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar texts."""
    return jaccard_join.first_of_groups(docs, words=WORDS, similarity=SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, decontaminate.benchmark_windows(items, unnamed=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, and the sequences that they lie in."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", similar),
    ("benchmark decontamination", benchmark),
    ("packing", pack),
]

ORACLE_SQL = None  # SQL has neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
