"""Shuffle files go with the execution that made them."""

import time

import pytest
from pyspark.sql import functions as F

from tideline.session import CLEANUP_CONF, materialise, shuffles_freed


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    table = materialise(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert table.agg(F.sum("count")).first()[0] == 1000


@pytest.mark.parametrize("value", ["true", "false"])
def test_the_cleanup_setting_is_put_back(spark, value):
    before = spark.conf.get(CLEANUP_CONF)
    spark.conf.set(CLEANUP_CONF, value)
    try:
        with pytest.raises(ValueError), shuffles_freed(spark):
            assert spark.conf.get(CLEANUP_CONF) == "true"
            raise ValueError
        assert spark.conf.get(CLEANUP_CONF) == value
    finally:
        spark.conf.set(CLEANUP_CONF, before)
