"""Running tallies of the receiver as aggregates over its outcome and prune logs. Each tally is a table of one row.

A tally begins anew when the receiver starts: give it the outcomes `since_start`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefold.functions.keys import filled
from pulsefold.functions.validation import VERSION
from pulsefold.operators.grid import BUCKETS, WINDOW_MS, epoch_slots
from pulsefold.operators.histogram import OVERFLOW, bounded_histogram
from pulsefold.operators.repeats import MAX_KEYS, TTL_MS

#: Statuses that count as rejections, and the cap of declared versions (fixed values).
REJECTED, VERSION_CAP = (400, 401, 404, 413, 415, 422), 32

#: Columns of an outcome, of a prune, and of a live key, as they are kept for the tallies.
OUTCOME = "seq long, arrived_at_ms long, declared string, key string, status int, reason string, deduped boolean, accepted int"
PRUNE = "at_ms long, before long, after long, pruned long, rewrote boolean"
ENTRY = "key string, expires_at long, insert_seq long"


def since_start(outcomes: DataFrame, started_at: int, instant: str = "arrived_at_ms") -> DataFrame:
    return outcomes.filter(F.col(instant) >= started_at)


def rejections(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status").isin(*REJECTED))


def totals(outcomes: DataFrame) -> DataFrame:
    """(tally, total, last_at): rejections, persist errors and repeats with the latest arrival of each."""
    one = lambda name, cond: outcomes.filter(cond).agg(F.count("*").alias("total"), F.max("arrived_at_ms").alias("last_at")).select(F.lit(name).alias("tally"), "total", "last_at")
    return one("rejections", F.col("status").isin(*REJECTED)).unionByName(one("persist_errors", F.col("status") == 503)).unionByName(one("deduped", F.col("deduped")))


def by_status(outcomes: DataFrame) -> DataFrame:
    return rejections(outcomes).groupBy("status").agg(F.count("*").alias("n"))


def by_declared_version(outcomes: DataFrame) -> DataFrame:
    """Declared versions of requests refused for them, the first ones seen and the rest together."""
    return bounded_histogram(outcomes.filter("status = 415"), "declared", ["seq"], VERSION_CAP)


def timeline(outcomes: DataFrame, chosen: Column, now: Column, weight: Column | None = None, window_ms: int = WINDOW_MS, buckets: int = BUCKETS) -> DataFrame:
    """The rolling timeline of the outcomes that `chosen` picks."""
    return epoch_slots(outcomes.filter(chosen), "arrived_at_ms", now, weight, window_ms, buckets)


def _listed(slots: DataFrame) -> DataFrame:
    """One row: the buckets of a timeline in order; there are a fixed number of them at most."""
    return slots.agg(F.sort_array(F.collect_list(F.struct("bucket_start", "bucket_end", "n"))).alias("buckets"))


def _pairs(df: DataFrame, key: str) -> DataFrame:
    """One row: a bounded histogram as array<struct<key, n>> by key."""
    return df.agg(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), "n"))).alias("counts"))


def _last(*columns: str, order: tuple[str, ...] = ("arrived_at_ms", "seq")) -> Column:
    """The latest row's `columns`; nulls where there is none."""
    return F.max_by(F.struct(*columns), F.struct(*order))


def rejection_tally(outcomes: DataFrame, now: Column) -> DataFrame:
    """total, by_status, by_declared_version, last_status, last_reason, last_seen, timeline."""
    own = rejections(outcomes)
    base = own.agg(F.count("*").alias("total"), _last("status", F.coalesce(filled(F.col("reason")), F.lit(None)).alias("reason"), "arrived_at_ms").alias("last"))
    return (
        base.select("total", F.col("last.status").alias("last_status"), F.col("last.reason").alias("last_reason"), F.col("last.arrived_at_ms").alias("last_seen"))
        .crossJoin(_pairs(by_status(outcomes), "status").withColumnRenamed("counts", "by_status"))  # each side is one row
        .crossJoin(_pairs(by_declared_version(outcomes), "declared").withColumnRenamed("counts", "by_declared_version"))
        .crossJoin(_listed(timeline(outcomes, F.col("status").isin(*REJECTED), now)).withColumnRenamed("buckets", "timeline"))
    )


def persist_tally(outcomes: DataFrame, now: Column) -> DataFrame:
    """total, last_reason, last_seen, timeline of the requests whose events could not be stored."""
    own = outcomes.filter("status = 503")
    base = own.agg(F.count("*").alias("total"), _last(filled(F.col("reason")).alias("reason"), "arrived_at_ms").alias("last"))
    return base.select("total", F.col("last.reason").alias("last_reason"), F.col("last.arrived_at_ms").alias("last_seen")).crossJoin(_listed(timeline(outcomes, F.col("status") == 503, now)).withColumnRenamed("buckets", "timeline"))


def dedup_tally(outcomes: DataFrame, now: Column) -> DataFrame:
    """total, last_seen, timeline of the repeats."""
    base = outcomes.filter("deduped").agg(F.count("*").alias("total"), F.max("arrived_at_ms").alias("last_seen"))
    return base.crossJoin(_listed(timeline(outcomes, F.col("deduped"), now)).withColumnRenamed("buckets", "timeline"))


def retention_tally(prunes: DataFrame, now: Column, max_rows: int = 0, max_age_ms: int = 0) -> DataFrame:
    """configured, retained, total_pruned, last, timeline of the prunes; the timeline weighs each by what it removed."""
    slots = epoch_slots(prunes.filter("pruned > 0"), "at_ms", now, F.col("pruned"))
    last = F.max_by(F.struct("before", "after", "pruned", "rewrote", "at_ms"), "at_ms")
    base = prunes.agg(F.coalesce(F.sum("pruned"), F.lit(0)).alias("total_pruned"), last.alias("last"))
    configured = F.struct(F.lit(max_rows).alias("max_rows"), F.lit(max_age_ms).alias("max_age_ms"))
    return base.select(configured.alias("configured"), F.coalesce("last.after", F.lit(0)).alias("retained"), "total_pruned", "last").crossJoin(_listed(slots).withColumnRenamed("buckets", "timeline"))


def seen_key_tally(live: DataFrame, max_keys: int = MAX_KEYS, ttl_ms: int = TTL_MS) -> DataFrame:
    configured = F.struct(F.lit(max_keys).alias("max_keys"), F.lit(ttl_ms).alias("ttl_ms"))
    return live.agg(F.count("*").alias("size")).select(configured.alias("configured"), "size")


def liveness(last_accepted: Column, started_at: Column, now: Column) -> Column:
    """struct<last_accepted_at, age_ms, accepted_since_boot>."""
    return F.struct(last_accepted.alias("last_accepted_at"), (now - last_accepted).alias("age_ms"), F.coalesce(last_accepted >= started_at, F.lit(False)).alias("accepted_since_boot"))


def liveness_row(last_accepted: DataFrame, outcomes: DataFrame, started_at: Column, now: Column) -> DataFrame:
    """One row: when events were last accepted and requests last rejected, and the versions that were declared in vain.

    `last_accepted` is one row with last_accepted_at.
    """
    rejected = rejections(outcomes).agg(F.max("arrived_at_ms").alias("last_rejection_at"))
    versions = by_declared_version(outcomes).filter(~F.col("declared").isin(OVERFLOW, str(VERSION))).agg(F.sort_array(F.collect_list("declared")).alias("mismatched_versions"))
    accepted = last_accepted.select(liveness(F.col("last_accepted_at"), started_at, now).alias("l")).select("l.*")
    return accepted.crossJoin(rejected).withColumn("rejection_age_ms", now - F.col("last_rejection_at")).crossJoin(versions)  # each side is one row
