"""Documents to sparse vectors: long ``(id, idx, value)`` rows, index/value arrays, ML vectors.

A document's tokens lie in its row, so they are looked up there: tasks hold the table of terms
(``sent_terms``), no token is a row, and a shuffle carries one row for each document. Only a table above
``TERM_BYTES`` is joined by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelkite.operators.skew import lookup_join
from labelkite.shared import fresh_path

TERM_BYTES = 256 * 1024 * 1024  # of a table of terms that tasks hold


def sent_terms(table: DataFrame, values: dict[str, Column], max_bytes: int = TERM_BYTES) -> Broadcast | None:
    """``term`` and the numbers ``values`` of a stored table, by the first of them, for all tasks; None above ``max_bytes``."""
    n, size = table.agg(F.count("*"), F.sum(F.octet_length("term").cast("long"))).first()
    if (size or 0) + n * (4 + 8 * len(values)) > max_bytes:
        return None
    found = table.where("term is not null").select("term", *[c.alias(name) for name, c in values.items()]).toArrow()
    return table.sparkSession.sparkContext.broadcast(found.sort_by(next(iter(values))).combine_chunks())


def known_terms(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, count)`` of each row's known terms, in this order: numbers of rows, places in ``terms``, times found."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    tokens = pc.list_flatten(lists)
    at = pc.index_in(tokens, value_set=terms.cast(tokens.type), skip_nulls=True)
    there = pc.is_valid(at).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)[there]
    width = max(len(terms), 1)
    cells, counts = np.unique(row * width + pc.drop_null(at).to_numpy().astype(np.int64), return_counts=True)
    return cells // width, cells % width, counts


def document_sums(
    docs: DataFrame, table: DataFrame, id: str, keep: list[str], sums: dict[str, Column], tokens: str = "tokens", max_bytes: int = TERM_BYTES
) -> DataFrame:
    """``(id, keep..., _n, sums...)``: known terms of each document, and sums of the terms' numbers (0 for no terms).

    ``sums`` are columns of the stored ``table``, which is unique on ``term``.
    """
    sent = sent_terms(table, {name: c.cast("double") for name, c in sums.items()}, max_bytes)
    names = list(sums)
    if sent is None:
        known = table.select("term", F.lit(1).alias("_n"), *[c.alias(name) for name, c in sums.items()])
        found = lookup_join(occurrences(docs, [id, *keep], tokens), known, "term", how="left")
    else:

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = [sent.value.column(name).to_numpy() for name in names]
            for batch in batches:
                n = batch.num_rows
                row, term, _ = known_terms(batch.column(n_kept), sent.value.column("term").combine_chunks())
                found = [np.bincount(row, minlength=n), *[np.bincount(row, x[term], n).astype(float) for x in numbers]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *map(pa.array, found)], [id, *keep, "_n", *names])

        kept = docs.select(id, *keep)
        n_kept = len(kept.columns)
        schema = T.StructType([*kept.schema.fields, T.StructField("_n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])
        found = docs.select(id, *keep, tokens).mapInArrow(rows, schema)
    total = {c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names}
    return found.groupBy(id, *keep).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), *total.values())


def term_counts(
    docs: DataFrame, id: str, tokens: str = "tokens", min_length: int = 1
) -> DataFrame:
    """``(id, term, tf)`` of each document."""
    terms = docs.select(id, F.explode(tokens).alias("term"))
    if min_length > 1:
        terms = terms.where(F.length("term") >= min_length)
    return terms.groupBy(id, "term").agg(F.count("*").alias("tf"))


def occurrences(docs: DataFrame, keep: list[str], tokens: str = "tokens") -> DataFrame:
    """One row for each document and distinct term; a document without terms has one null term."""
    return docs.select(*keep, F.explode_outer(F.array_distinct(tokens)).alias("term"))


def apply_spec(
    docs: DataFrame,
    spec: DataFrame,
    id: str,
    keep: list[str],
    number: str = "occurrence",
    tokens: str = "tokens",
) -> DataFrame:
    """Long vectors ``(id, keep..., idx, value)`` of the terms that the stored spec knows.

    ``number='occurrence'`` gives 1 for a term that occurs, ``'tf'`` its count. A document without
    a known term keeps rows with a null ``idx``.
    """
    if number == "occurrence":
        terms = occurrences(docs, [id, *keep], tokens).withColumn("value", F.lit(1.0))
    elif number == "tf":
        terms = (
            docs.select(id, *keep, F.explode_outer(tokens).alias("term"))
            .groupBy(id, *keep, "term")
            .agg(F.count("*").cast("double").alias("value"))
        )
    else:
        raise ValueError(f"unknown number rule {number!r}")
    table = spec.select("term", "idx", "doc_freq")
    found = lookup_join(terms, table, "term", how="left")
    return found.select(id, *keep, "idx", "value")


def doc_vectors(
    docs: DataFrame,
    spec: DataFrame,
    id: str,
    keep: list[str] | None = None,
    number: str = "occurrence",
    tokens: str = "tokens",
    max_bytes: int = TERM_BYTES,
) -> DataFrame:
    """``(id, keep..., indices, values)`` with sorted indices; empty arrays where nothing is known.

    A document's row is as long as its own text at most. Rows that repeat an id are one document.
    """
    keep = keep or []
    sent = sent_terms(spec, {"idx": F.col("idx").cast("int")}, max_bytes) if number in ("occurrence", "tf") else None
    if sent is None:
        return _arrays(apply_spec(docs, spec, id, keep, number, tokens), id, keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value.column("idx").to_numpy()
        for batch in batches:
            row, term, count = known_terms(batch.column(n_kept), sent.value.column("term").combine_chunks())
            borders = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]), pa.int32())
            value = np.ones(len(term)) if number == "occurrence" else count.astype(float)
            lists = [pa.ListArray.from_arrays(borders, pa.array(x)) for x in (numbers[term], value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *lists], [id, *keep, "indices", "values"])

    kept = docs.select(id, *keep)
    n_kept = len(kept.columns)
    lists = [T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    found = docs.select(id, *keep, tokens).mapInArrow(rows, T.StructType([*kept.schema.fields, *lists]))
    grouped = found.groupBy(id, *keep).agg(F.collect_list(F.struct("indices", "values")).alias("_rows"))
    whole = grouped.where(F.size("_rows") == 1).select(id, *keep, F.col("_rows")[0]["indices"].alias("indices"), F.col("_rows")[0]["values"].alias("values"))
    parts = grouped.where(F.size("_rows") > 1).select(id, *keep, F.explode("_rows").alias("_r"))
    parts = parts.select(id, *keep, F.inline_outer(F.arrays_zip(F.col("_r.indices").alias("idx"), F.col("_r.values").alias("value"))))
    once = F.max("value") if number == "occurrence" else F.sum("value")
    return whole.unionByName(_arrays(parts.groupBy(id, *keep, "idx").agg(once.alias("value")), id, keep))


def _arrays(entries: DataFrame, id: str, keep: list[str]) -> DataFrame:
    """Long vectors as one row for each document."""
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", "value"))
    grouped = entries.groupBy(id, *keep).agg(F.array_sort(F.collect_set(entry)).alias("_e"))
    return grouped.select(
        id,
        *keep,
        F.transform("_e", lambda e: e["idx"].cast("int")).alias("indices"),
        F.transform("_e", lambda e: e["value"]).alias("values"),
    )


def ml_vectors(vectors: DataFrame, length: int) -> DataFrame:
    """Stored table with a ``features`` column of sparse ML vectors, for the iterative learners.

    The arrays are written in the vector type's own layout and read back as that type, so that no
    Python code touches the rows, and each pass of a learner reads a stored table.
    """
    path = fresh_path(vectors.sparkSession, "vectors")
    others = [c for c in vectors.columns if c not in ("indices", "values")]
    layout = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(length).cast("int").alias("size"),
        F.col("indices"),
        F.col("values"),
    )
    vectors.select(*others, layout.alias("features")).hint("rebalance").write.parquet(path)
    fields = [vectors.schema[c] for c in others]
    schema = T.StructType([*fields, T.StructField("features", VectorUDT())])
    return vectors.sparkSession.read.schema(schema).parquet(path)
