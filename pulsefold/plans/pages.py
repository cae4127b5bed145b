"""The two small read documents: a page of events, and what the receiver accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.functions.numbers import parameter_number
from pulsefold.functions.validation import ACCEPTED, VERSION
from pulsefold.operators.retention import newest, page_limit, page_offset
from pulsefold.sources.ndjson import filtered, typed
from pulsefold.sources.store import Snapshot


def page(log: DataFrame | Snapshot, limit: str | None = None, offset: str | None = None, since: str | None = None, **filters: str | None) -> DataFrame:
    """One row: events (JSON texts in order of arrival), total, matched, limit and offset as they were applied.

    `log` is a version of the store or a parsed log; parameters come as text, as in a query string. total counts every JSON value of the log,
    matched the events that meet all filters. A page holds a bounded number of events, so it fits in one row.
    """
    bound = None if since is None else parameter_number(since)
    n = page_limit(parameter_number(limit))
    if isinstance(log, Snapshot):
        spark, total = log.spark, log.total
        matched, skip, rows = _sought(log, n, parameter_number(offset), bound, filters)
    else:
        spark, total = log.sparkSession, log.agg(F.count("event")).first()[0]
        matching = filtered(typed(log), since=bound, **filters)
        matched = matching.count()
        skip = page_offset(parameter_number(offset), matched)
        rows = newest(matching.select("seq", F.to_json("event").alias("event")), "seq", n, skip)
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("seq", "event")))["event"].alias("events"))
    return listed.select("events", *[F.lit(x).cast("long").alias(c) for c, x in (("total", total), ("matched", matched))], F.lit(n).alias("limit"), F.lit(skip).alias("offset"))


def _sought(log: Snapshot, n: int, asked: float, since: float | None, filters: dict[str, str | None]) -> tuple[int, int, DataFrame]:
    """(matched, offset, the page's rows): a page opens only the parts that hold its events.

    How many events of a part match is known from its manifest without filters, and from its rollup with filters by label; only `since`
    counts the part's rows. Parts whose arrivals overlap are one stretch, read together; stretches before the page's are not read.
    """
    bounded = since is not None and abs(since) < float("inf")
    if bounded:
        rows = log.events(since, **filters).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()
    elif any(filters.values()):
        rows = log.rollup(**filters).groupBy(F.input_file_name().alias("file")).agg(F.sum("weight").alias("n")).collect()
    else:
        rows = None
    count = {p["path"]: p["rows"] if rows is None else 0 for p in log.parts}
    name = {(p["path"] if bounded else p["rollup"]).rpartition("/")[2]: p["path"] for p in log.parts}
    for r in rows or []:
        count[name[next(x for x in r["file"].split("/") if x in name)]] += r["n"]
    matched = sum(count.values())
    skip = page_offset(asked, matched)
    # stretches of parts with overlapping arrivals, the latest first
    stretches: list[list[dict]] = []
    for p in sorted((p for p in log.parts if count[p["path"]]), key=lambda p: -p["high_seq"]):
        if stretches and p["high_seq"] >= min(q["low_seq"] for q in stretches[-1]):
            stretches[-1].append(p)
        else:
            stretches.append([p])
    chosen, before, passed = [], 0, 0
    for s in stretches:
        own = sum(count[p["path"]] for p in s)
        if passed + own > skip and passed < skip + n:
            before = before if chosen else passed
            chosen += s
        passed += own
    found = filtered(log.of(chosen), since=since, **filters)
    return matched, skip, newest(found.select("seq", F.to_json("event").alias("event")), "seq", n, skip - before)


def capabilities(spark: SparkSession, needs_token: bool) -> DataFrame:
    """One row: the own schema version, the accepted ones ascending, and if a token is asked for."""
    return spark.createDataFrame([(VERSION, sorted({*ACCEPTED, VERSION}), needs_token)], "schema_version int, accepted_versions array<int>, auth boolean")
