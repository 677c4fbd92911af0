import time

from pyspark.sql import functions as F

from pairloom.runtime import FREE_SHUFFLES, stage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    before, given = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES)
    df = spark.range(5000).repartition(7, "id").groupBy(F.col("id") % 11).count()
    staged = stage(df, "freed")
    left = shuffle_files(spark) - before
    for _ in range(100):
        if not left:
            break
        time.sleep(0.1)
        left = shuffle_files(spark) - before
    assert not left
    assert staged.count() == 11 and df.count() == 11
    assert spark.conf.get(FREE_SHUFFLES) == given
