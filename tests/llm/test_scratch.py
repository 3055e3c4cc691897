"""A table that is written and read back leaves no shuffle files behind it."""

import time

from pyspark.sql import functions as F

from quillmill.llm import common


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, setting = held(), spark.conf.get(common.CLEANUP, None)
    table = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10  # files go in the background
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(common.CLEANUP, None) == setting
    assert table.count() == 7
    common.discard(table)
