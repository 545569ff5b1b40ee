"""Tables in the shared folder."""

import glob
import os
import time

from pyspark.sql import functions as F

from helixframe.storage import saved

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp")
    return set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data") + glob.glob(f"{top}/*/blockmgr-*/*/shuffle_*.data"))


def test_shuffle_files_of_a_saved_table_go(spark):
    before, was = shuffle_files(spark), spark.conf.get(SETTING, None)
    counts = spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n"))
    counts.write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) - before, "the files are looked for where Spark writes them"
    before = shuffle_files(spark)
    got = saved(counts.join(counts.withColumnRenamed("n", "m"), "k"))
    for _ in range(50):  # they are removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert got.where("n = 20 and m = 20").count() == 5000 and spark.conf.get(SETTING, None) == was
