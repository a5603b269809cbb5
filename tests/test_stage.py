"""Staging: what a write leaves behind."""

import time

from panelwright.session import CLEANUP, stage, unstage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())}


def test_the_shuffle_files_of_a_staged_frame_go_with_its_write(spark):
    held, before = spark.conf.get(CLEANUP, None), shuffle_files(spark)
    rows = spark.range(5000, numPartitions=3).selectExpr("id", "id % 700 AS k").groupBy("k").count()
    table = stage(rows)
    for _ in range(50):
        left = {name for name in shuffle_files(spark) - before if name.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 700 and rows.count() == 700
    assert spark.conf.get(CLEANUP, None) == held
    unstage(table)
