"""Token counts of whole texts, without making ids.

Each distinct pre-token (a piece between places where the tokenizer always cuts) is counted once in a
Python worker; a text's count is the sum, over its pre-tokens, of frequency times count. The join of
frequencies and counts is by piece number inside the task: shuffling one row for each document and
distinct pre-token would move several times the input.

Nulls: a null text has 0 bytes and 0 tokens, as an empty one. Ids may be null or repeat: one row comes
out for each row that goes in. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.bytehash import slices, text_bytes
from labelkite.llm.pieces import PieceCoder


def token_counts(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` by a file of the tokenizers library that all executors have."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.of_worker(tokenizer, keep_ids=False)
        for batch in batches:
            raw, borders = text_bytes(batch.column(1))
            parts = [
                coder.counts(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
                for a, b in slices(borders)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(borders), pa.int64()),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
