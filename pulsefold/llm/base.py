"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefold.sources.scratch import shared_folder, written  # noqa: F401

#: A word between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest number of rows of a table that is broadcast; the rows are narrow (names and numbers).
BROADCAST_ROWS = 10_000


def held(df: DataFrame) -> DataFrame:
    """A narrow table, computed once and kept in the shared folder; its lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it has at most `rows` rows; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """`df`, read from files, dealt anew if it comes from fewer partitions with rows than tasks can run at once.

    A file of one row group is one task, however many cores there are.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= tasks or df.select(F.spark_partition_id()).distinct().count() >= tasks:
        return df
    return df.repartition(tasks)


def chunked(values: Column, size: int) -> Column:
    """The array in pieces of `size` elements; it has one at least."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size)), lambda c: F.slice(values, (c * size + 1).cast("int"), F.lit(size)))


def _added(values: Column, start: Column) -> Column:
    """start, start + values[0], ... without the last sum; arrays grow by copies here, so `values` should be short."""
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])


def sums_before(values: Column, size: int = 128) -> Column:
    """For each of the integers `values` (one at least) the sum of those before it. Chunks keep what is copied small."""
    chunks = chunked(values, size)
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
    return F.flatten(F.zip_with(chunks, _added(totals, F.lit(0)), _added))


def starts_of(text: Column, pattern: str, matches: Column) -> Column:
    """Start offsets in code points of `matches`, the array of all matches of `pattern` in `text`."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda g: F.length(g))
    lengths = F.zip_with(gaps, matches, lambda g, m: g + F.length(m))
    sums = F.zip_with(sums_before(lengths), gaps, lambda s, g: s + g)
    return F.when(F.size(matches) > 0, sums).otherwise(F.array().cast("array<int>"))
