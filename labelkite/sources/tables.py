"""Stored tables of documents: read, write, replace by key, schema-free documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.shared import forget, written

JOIN_BYTES = 32 * 1024 * 1024  # of stored files, for each task of a join that moves their rows


def read_documents(
    spark: SparkSession, path: str, fields: list[str] | None = None, where: Column | str | None = None
) -> DataFrame:
    """A stored table; the chosen fields and the filter reach the file scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*fields) if fields else df


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Deal the rows out to ``parts`` tasks, for a small table with heavy work on a row; None leaves it."""
    return df.repartition(parts) if parts else df


def join_parts(spark: SparkSession, path: str, max_bytes: int = JOIN_BYTES) -> int | None:
    """Parts for a join that moves a stored table's rows, so that each is about ``max_bytes`` of its files.

    None where the session's number of shuffle partitions is enough. That number is fixed, so beyond it a task
    would read more the larger the table is.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(folder).getLength()
    parts = -(-size // max_bytes)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Create or replace a table (``overwrite``), or add to it (``append``)."""
    df.write.mode(mode).parquet(path)


def bulk_write(parts: list[DataFrame], path: str) -> None:
    """Replace the table by the first part, then append the others."""
    for i, part in enumerate(parts):
        write_documents(part, path, "append" if i else "overwrite")


def with_new_ids(rows: DataFrame, name: str = "id") -> DataFrame:
    """A new id for each row. Store the result before reading it twice: the ids are random."""
    return rows.withColumn(name, F.uuid())


def upsert_documents(
    target: DataFrame, rows: DataFrame, key: str, version: str | None = None
) -> DataFrame:
    """One row for each key: a new row where there is one, else the target's.

    ``version`` orders new rows of the same key: the last one stays. Among rows that it leaves equal,
    the one with the largest hash of its cells stays, so a repeated run keeps the same one. One
    aggregate over both tables, partial before the shuffle: many copies of a key are cheap.
    """
    fields = [c for c in target.columns if c != key]
    order = F.col(version) if version else F.lit(0)
    cells = F.struct(*fields).alias("_r")
    new = rows.select(key, F.struct(F.lit(1).alias("new"), order.alias("v"), F.xxhash64(*fields).alias("h")).alias("_o"), cells)
    kind = dict(new.select("_o.v").dtypes)["v"]
    no_order = F.lit(None).cast(kind)
    old = target.select(
        key, F.struct(F.lit(0).alias("new"), no_order.alias("v"), F.xxhash64(*fields).alias("h")).alias("_o"), cells
    )
    last = old.unionByName(new).groupBy(key).agg(F.max_by("_r", "_o").alias("_r"))
    return last.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in target.columns])


BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    """Number of the folder that a key's rows lie in; a null key has one as well."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Create or replace a table laid out by a hash of its key, one folder for each bucket."""
    _to_buckets(df, path, key, buckets)


def _to_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    number = bucket_of(key, buckets)
    dealt = df.withColumn(BUCKET, number).repartition(BUCKET)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert_bucketed(
    spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int, version: str | None = None
) -> list[int]:
    """``upsert_documents`` on a stored table of ``write_bucketed``; the buckets that were rewritten.

    The changes are stored first, so that their buckets and their rows are the same however often a task
    runs. Only folders with a changed key are read (the filter on the folder reaches the scan) and
    replaced, all others stay as they are: work grows with the changes, not with the table. Choose
    ``buckets`` so that one holds what a task can, and keep it; another number finds other folders.
    """
    changes = written(rows.withColumn(BUCKET, bucket_of(key, buckets)), "changes")
    touched = [r[0] for r in changes.select(BUCKET).distinct().orderBy(BUCKET).collect()]  # ``buckets`` at most
    if touched:
        target = spark.read.parquet(path)
        old = target.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = written(upsert_documents(old, changes.drop(BUCKET), key, version), "merged")
        _to_buckets(merged, path, key, buckets)
        forget(merged)
    forget(changes)
    return touched


def as_variant(json_text: Column) -> Column:
    """A schema-free document from JSON text."""
    return F.parse_json(json_text)


def write_variant_docs(df: DataFrame, json_column: str, paths: list[str], name: str = "doc") -> None:
    """Documents with differing keys, written to one or more targets from one parse."""
    docs = df.withColumn(name, as_variant(F.col(json_column))).drop(json_column)
    docs.write.mode("overwrite").parquet(paths[0])
    for path in paths[1:]:
        df.sparkSession.read.parquet(paths[0]).write.mode("overwrite").parquet(path)


def variant_field(doc: str | Column, key: str, kind: str) -> Column:
    """One field of a schema-free document; null where the document lacks it."""
    column = F.col(doc) if isinstance(doc, str) else doc
    return F.try_variant_get(column, f"$.{key}", kind)


def write_synonyms(lines: DataFrame, path: str) -> None:
    """Synonym lines as text files, written by the tasks that hold them."""
    lines.select("line").write.mode("overwrite").text(path)
