"""Session settings and durable staging shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators are designed for.

    Fact-to-dimension joins keep the fact on the left, so adaptive skew
    handling may split a hot key on the fact side; forcing it allows the extra
    shuffle when a later operator wanted the join's partitioning.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for setting in ("coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes"):
        spark.conf.unset(f"spark.sql.adaptive.{setting}")
    given = spark.sparkContext.getConf().get(READ_SIZE)
    if given is None:
        spark.conf.unset(READ_SIZE)
    else:
        spark.conf.set(READ_SIZE, given)
    return spark


#: Pieces of a shuffle before adaptive execution joins small ones to about this size.
#: Keys compress well: 64 MB of them took 1.8 GB of a task's memory to sort.
SHUFFLE_PIECES, PIECE_SIZE = 512, "16m"
READ_SIZE = "spark.sql.files.maxPartitionBytes"


def fine_shuffles(spark: SparkSession) -> SparkSession:
    """Cut shuffles finely, so that what a task sorts or hashes is bounded by the advisory
    size of a piece and does not grow with the table over a fixed number of partitions.
    Files are read in pieces of that size as well: what a reading task groups or sorts
    before a shuffle grows with its piece."""
    pieces = max(SHUFFLE_PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(pieces))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PIECE_SIZE)
    spark.conf.set(READ_SIZE, PIECE_SIZE)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the session's ``spark.checkpoint.dir``,
    else the warehouse folder, which driver and executors share as well."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    return (shared or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. The paths of one application share a
    folder, which may be removed after it."""
    app = spark.sparkContext.applicationId
    return f"{work_dir(spark)}/pairloom/{app}/{label}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query when it ends, not when the driver's heap is
#: next collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Runtime setting ``name`` at ``value`` for as long as this lasts."""
    given = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, given)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    This cuts the lineage of iterative jobs and pins the rows, so values that
    depend on physical layout stay the same when an executor is lost. The shuffle
    files of the write go with it; other actions, such as local iterators, which
    still read after the call, keep theirs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with setting(spark, FREE_SHUFFLES, "true"):
        df.write.mode("errorifexists").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the files under a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def drop_stage(staged: DataFrame) -> None:
    """Delete the files of a table that ``stage`` wrote, once its successor is
    written. The frame, and every frame made from it, is then unreadable."""
    _delete(staged.sparkSession, staged.staged_path)


def drop_all_stages(spark: SparkSession) -> None:
    """Delete everything this application staged, once its results are written."""
    _delete(spark, f"{work_dir(spark)}/pairloom/{spark.sparkContext.applicationId}")
