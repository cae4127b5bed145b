"""Timelines: a grid that ends now, and slots of the epoch that are laid over such a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefold.functions.numbers import finite

#: The usual timeline: 24 hours in 48 buckets.
WINDOW_MS, BUCKETS = 86_400_000, 48


def now_grid(df: DataFrame, instant: str, now: Column, window_ms: int = WINDOW_MS, buckets: int = BUCKETS) -> DataFrame:
    """`df` with bucket (0-based), bucket_start and bucket_end, for the rows from the window's start up to now.

    The grid hangs on `now`, not on the epoch. Rows before the window, after now or without an instant are
    left out; without a window or a bucket, all are.
    """
    if window_ms <= 0 or buckets < 1:
        return df.filter(F.lit(False)).withColumns({c: F.lit(None).cast("long") for c in ("bucket", "bucket_start", "bucket_end")})
    width = window_ms / buckets
    start = now - window_ms
    inside = df.filter(finite(F.col(instant)) & (F.col(instant) >= start) & (F.col(instant) <= now))
    bucket = F.least(F.floor((F.col(instant) - start) / width), F.lit(buckets - 1)).cast("long")
    placed = inside.withColumn("bucket", bucket)
    return placed.withColumn("bucket_start", (start + F.col("bucket") * width).cast("long")).withColumn("bucket_end", (start + (F.col("bucket") + 1) * width).cast("long"))


def epoch_slots(df: DataFrame, instant: str, now: Column, weight: Column | None = None, window_ms: int = WINDOW_MS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, bucket_start, bucket_end, n): weights by slot of the epoch, laid over the grid that ends now.

    A slot is a multiple of the bucket width since the epoch. Slots that begin before the window are left out;
    later ones than the newest bucket count there. A weight that is not positive and finite counts as 1. Without a
    window or a bucket there are no slots.
    """
    if window_ms <= 0 or buckets < 1:
        return df.sparkSession.createDataFrame([], "bucket long, bucket_start long, bucket_end long, n long")
    width = window_ms / buckets
    weight = F.lit(1) if weight is None else F.when(finite(weight) & (weight > 0), weight).otherwise(F.lit(1))
    slots = df.filter(finite(F.col(instant))).groupBy(F.floor(F.col(instant) / width).alias("slot")).agg(F.sum(weight).alias("n"))
    start = now - window_ms
    index = F.floor((F.col("slot") * width - start) / width)
    laid = slots.withColumn("bucket", index).filter("bucket >= 0").withColumn("bucket", F.least("bucket", F.lit(buckets - 1)))
    out = laid.groupBy("bucket").agg(F.sum("n").alias("n"))
    return out.select("bucket", (start + F.col("bucket") * width).cast("long").alias("bucket_start"), (start + (F.col("bucket") + 1) * width).cast("long").alias("bucket_end"), "n")
