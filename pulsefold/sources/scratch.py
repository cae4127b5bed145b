"""Tables that are kept for a while in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may leave it unset."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pulsefold-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession) -> str:
    """A name in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # else there is nothing yet to remove in the end
    fs.deleteOnExit(at)
    return f"{path}/data"


@contextmanager
def temporary(df: DataFrame, compression: str | None = None) -> Iterator[DataFrame]:
    """The table, written as Parquet and read again, for as long as the block lasts."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path, compression=compression)
        yield spark.read.parquet(path)
    finally:
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def bucketed(df: DataFrame, column: str, buckets: int) -> Iterator[DataFrame]:
    """The table, written in buckets by `column` and read again, for as long as the block lasts.

    What is grouped by that column, or joined by it in as many partitions, reads its bucket and is not shuffled.
    """
    spark = df.sparkSession
    name = f"pulsefold_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/table-{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.bucketBy(buckets, column).sortBy(column).option("path", path).option("compression", "zstd").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While the block lasts, the shuffle files of a query go when it ends, and not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, compression: str | None = None, file_rows: int = 0) -> DataFrame:
    """The table, written as Parquet and read again: its lineage ends here, and nothing is computed twice.

    A file holds `file_rows` rows at most, if that is given: of rows that are read fast but worked on for long, tasks can
    then take less than what a row group holds. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path, compression=compression)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)
