"""Tables of a step leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from citespark.llm.common import CLEANUP, Scratch


def test_shuffle_files_go_with_the_table(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, had = files(), spark.conf.get(CLEANUP, None)
    made = Scratch(spark, "clean").put("t", spark.range(1000).repartition(4, "id").groupBy("id").agg(F.count("*").alias("n")))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert made.count() == 1000 and spark.conf.get(CLEANUP, None) == had
