"""Tables that end a lineage."""

import time

from pyspark.sql import functions as F
from spanwise import session


def test_shuffles_of_a_written_table_go(spark):
    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}

    before = shuffles()
    table = session.materialize(spark.range(50_000).repartition(7).groupBy((F.col("id") % 999).alias("k")).count(), "t-shuffles")
    left = shuffles() - before
    for _ in range(50):  # files go in the background
        if left:
            time.sleep(0.1)
            left = shuffles() - before
    assert not left and table.count() == 999
    assert spark.conf.get(session.CLEANUP, "false") == "false"
