"""Rollups: the labels of many events with their counts and extremes, which add up over parts of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefold.functions.numbers import when_finite
from pulsefold.functions.schema import struct_of

#: What a row of a rollup stands for.
LABELS = ("type", "runtime", "platform", "app_version", "schema_version", "schema_number", "signature", "error_name", "reason", "source")
COLUMNS = struct_of(
    ", ".join(f"{c} {'double' if c == 'schema_number' else 'string'}" for c in LABELS)
    + ", weight long, seq long, low_instant double, high_instant double, lag_n long, lag_low double, lag_high double, lag_total double"
)


def rollup(events: DataFrame) -> DataFrame:
    """A row for each combination of labels in `events`: weight counts its events, seq is the first arrival.

    Rollups of parts, put together, are a rollup of the whole: the axes of the summary that read labels alone take either.
    """
    lag = when_finite(F.col("lag"))
    return events.groupBy(*LABELS).agg(
        F.count("*").alias("weight"),
        F.min("seq").alias("seq"),
        F.min("instant").alias("low_instant"),
        F.max("instant").alias("high_instant"),
        F.count(lag).alias("lag_n"),
        F.min(lag).alias("lag_low"),
        F.max(lag).alias("lag_high"),
        F.sum(lag).alias("lag_total"),
    )
