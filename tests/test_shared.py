import pytest
from pyspark.sql import functions as F

from labelkite.shared import CLEANUP, forget, written


def test_written_keeps_the_setting_and_forget_deletes(spark):
    before = spark.conf.get(CLEANUP)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = written(rows, "sevenths")
    assert spark.conf.get(CLEANUP) == before
    assert stored.agg(F.sum("count")).first()[0] == 1000 and written(rows, "again").count() == 7
    forget(stored)
    with pytest.raises(Exception):
        spark.read.parquet(stored._stored_at)
