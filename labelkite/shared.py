"""Session helper and the folder that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TEXT_PARTS = "spark.labelkite.textParts"  # tasks that a text table is dealt out to; unset: as its files are
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A one-machine session for tests and timing; a cluster brings its own.

    Its shared folder is below the warehouse, unless one is set already.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("labelkite")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config(TEXT_PARTS, str(partitions))
        .getOrCreate()
    )
    if spark.sparkContext.getConf().get("spark.checkpoint.dir") is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/shared")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; tests and timing set one where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses; it goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, name: str, even: bool = False, files: int | None = None) -> DataFrame:
    """Store a table in the shared folder and read it back.

    Cuts the lineage: a table that is used twice is computed once, survives lost executors, and
    has a known size, so that Spark can choose its joins. ``even`` writes files of about one size,
    for tables that an iterative learner reads many times: few tasks for a small one, no large file.
    ``files`` is the most that a table of known size is worth: each file costs a task and, on a local
    folder, processes that Hadoop starts to set its rights.
    The shuffle files that led to the table go once it is stored. Files are compressed by zstd, as
    they are read a few times at most and lie on shared storage.
    """
    if even:
        df = df.hint("rebalance")
    if files is not None:
        df = df.coalesce(max(1, files))
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def forget(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more; without it, it goes with the application."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
