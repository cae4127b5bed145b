"""Retention by age and count, and the pages of the newest events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefold.functions.numbers import finite

#: Events of a page unless asked otherwise, and at most.
PAGE, LARGEST_PAGE = 100, 200


def page_limit(asked: float | None) -> int:
    return min(math.floor(asked), LARGEST_PAGE) if asked is not None and math.isfinite(asked) and asked >= 1 else PAGE


def page_offset(asked: float | None, matched: int) -> int:
    return min(math.floor(asked), matched) if asked is not None and math.isfinite(asked) and asked > 0 else 0


def newest(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """The `limit` latest rows after skipping the `offset` latest, in order of arrival."""
    return df.orderBy(F.col(order).desc()).offset(offset).limit(limit).orderBy(order)


def within_age(df: DataFrame, instant: str, now: Column, max_age_ms: float) -> DataFrame:
    """The rows not older than `max_age_ms`, and those without a usable instant; 0 keeps all."""
    if max_age_ms <= 0:
        return df
    return df.filter(~finite(F.col(instant)) | (F.col(instant) >= now - max_age_ms))


def nth_latest(df: DataFrame, order: str, n: int, buckets: int = 4096) -> int | None:
    """The n-th largest of the whole numbers in a column; the least, if there are fewer; null of none.

    A histogram tells in which bucket it lies, and only that one is looked at again, so no row is sorted and a pass sends `buckets`
    counts to the driver. Numbers of 64 bits take six passes at most.
    """
    low, high, rows = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if rows <= n:
        return low
    while low < high:
        width = -(-(high - low + 1) // buckets)
        inside = df.filter(F.col(order).between(low, high))
        wide = high - low >= 1 << 63  # a difference may leave 64 bits
        above = F.col(order).cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)") if wide else F.col(order) - F.lit(low)
        counts = inside.select(above.alias("above")).groupBy(F.expr(f"above div {width}").alias("b")).agg(F.count("*").alias("n")).collect()
        for b, c in sorted(((r["b"], r["n"]) for r in counts), reverse=True):
            if c >= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            n -= c
    return low


def within_count(df: DataFrame, order: str, max_rows: int) -> DataFrame:
    """The `max_rows` latest rows by the whole numbers of `order`; 0 keeps all.

    The order value of the oldest row to stay is found by `nth_latest` and the rows are filtered by it, so the table is not sorted.
    """
    if max_rows <= 0:
        return df
    edge = nth_latest(df.select(order), order, max_rows)
    return df if edge is None else df.filter(F.col(order) >= edge)


def retained(df: DataFrame, order: str, instant: str, now: Column, max_rows: int = 0, max_age_ms: float = 0) -> DataFrame:
    """The rows that stay: by age first, then by count."""
    return within_count(within_age(df, instant, now, max_age_ms), order, max_rows)
