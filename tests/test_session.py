import os
import time

from pyspark.sql import functions as F

from lociforge.session import Cut


def shuffle_files(spark):
    places = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {name for place in places for _, _, names in os.walk(place) for name in names if name.startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    cut = Cut(spark)
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    back = cut.write(rows.join(rows.select("k", F.col("s").alias("t")).repartition(4, "k"), "k"))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and back.count() == 100 and back.filter("s <> t").count() == 0
    cut.close()
