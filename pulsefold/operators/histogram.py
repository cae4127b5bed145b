"""Bounded histograms, top-k rankings and bucket percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bucket of the keys beyond the cap.
OVERFLOW = "__overflow__"


def bounded_histogram(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    cap: int,
    aggregates: dict[str, tuple[Column, str]] | None = None,
    partition: Sequence[str] = (),
) -> DataFrame:
    """(partition..., key, aggregates...): the `cap` keys seen first keep their bucket, the others share one.

    `order` are the columns of arrival. `aggregates` gives for each name an aggregate over the rows of a key and
    the function, sum, min or max, by which those of the shared bucket merge (default: n, a count). Null keys are
    left out. Rows are aggregated by key before any ranking, and without a partition the first keys are a
    distributed top-k, so no task sees more than `cap` keys at once.
    """
    aggregates = aggregates or {"n": (F.count("*"), "sum")}
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    by_key = df.filter(F.col(key).isNotNull()).groupBy(*partition, key).agg(F.min(F.struct(*order)).alias("__first"), *[a.alias(n) for n, (a, _) in aggregates.items()])
    if partition:
        rank = F.row_number().over(Window.partitionBy(*partition).orderBy("__first"))
        named = by_key.withColumn("__key", F.when(rank <= cap, F.col(key).cast("string")).otherwise(F.lit(OVERFLOW)))
    else:
        first = by_key.orderBy("__first").limit(cap).select(F.col(key).alias("__kept"))
        # broadcast: `cap` rows at most
        named = by_key.join(F.broadcast(first), F.col(key) == F.col("__kept"), "left").withColumn("__key", F.coalesce(F.col("__kept").cast("string"), F.lit(OVERFLOW)))
    return named.groupBy(*partition, F.col("__key").alias(key)).agg(*[merge[how](n).alias(n) for n, (_, how) in aggregates.items()])


def top_k(df: DataFrame, keys: Sequence[str], k: int, count: Column | None = None) -> DataFrame:
    """(keys..., n): the k most frequent combinations of the keys, ties by the keys in order. A null first key counts nowhere.

    `count` is an aggregate that says how many rows a group stands for (default: as many as it has).

    Null keys go after the aggregation: a filter on the key would be pushed below the expression that makes it and
    evaluate that twice.
    """
    n = F.count(keys[0]) if count is None else F.when(F.count(keys[0]) > 0, count).otherwise(0)
    return df.groupBy(*keys).agg(n.alias("n")).filter("n > 0").orderBy(F.col("n").desc(), *keys).limit(k)


def bucket_index(value: Column, boundaries: Sequence[float]) -> Column:
    """The first bucket whose boundary is not below the value; the number of boundaries beyond the last."""
    out = F.lit(len(boundaries))
    for i in reversed(range(len(boundaries))):
        out = F.when(value <= boundaries[i], F.lit(i)).otherwise(out)
    return out


def bucket_percentiles(buckets: DataFrame, by: Sequence[str], index: str, count: str, boundary: str, ranks: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """(by..., p50, p95, p99): nearest-rank upper boundaries; null where the rank lies beyond the last boundary.

    `buckets` has a row per group and bucket: its index, count and boundary (null for the last one).
    """
    upward = Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    run = buckets.withColumn("__upto", F.sum(count).over(upward)).withColumn("__all", F.sum(count).over(Window.partitionBy(*by)))
    rank = lambda p: F.floor((F.col("__all") * p + 99) / 100)  # noqa: E731  the ceiling of p percent, in whole numbers
    found = lambda p: F.min(F.when((F.col("__all") > 0) & (F.col("__upto") >= rank(p)), F.struct(index, boundary)))[boundary]
    return run.groupBy(*by).agg(*[found(p).alias(f"p{p}") for p in ranks])
