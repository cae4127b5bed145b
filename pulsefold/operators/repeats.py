"""Idempotency: which arrivals of a key are accepted when an accepted one hides the key for a while."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefold.sources.scratch import written

#: How long an accepted key is remembered, and how many keys.
TTL_MS, MAX_KEYS = 600_000, 10_000
#: Arrivals from which on a key is spread over tasks, keys of that kind that are listed in a filter, and the slice of time that one task takes.
HOT_ROWS, HOT_KEYS, SLICE_MS = 1_000_000, 1000, 1 << 20


def accepted_arrivals(df: DataFrame, key: str, instant: str, order: str, ttl_ms: int = TTL_MS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`df` with accepted: an arrival counts unless an accepted one of its key came less than the TTL before.

    Refused arrivals don't prolong the memory. A null or empty key is always accepted; with a key, an arrival without
    an instant never is. `order` tells arrivals of one key and instant apart. Keys of at most `hot_rows` arrivals are sorted within partitions and
    read as a stream that remembers one key and one instant; those of more are spread over tasks by `spread_arrivals`.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    free = df.filter(text == "").withColumn("accepted", F.lit(True))
    some = df.filter(text != "").withColumns({"__key": text, "__at": F.col(instant).cast("long")})
    # as many hot keys as fit in a sum of rows: few, and counted before they are broadcast
    hot = some.groupBy("__key").agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows).select(F.col("__key").alias("__hot"))
    names = [r["__hot"] for r in hot.take(HOT_KEYS + 1)]
    if not names:
        return _streamed(some, order, ttl_ms, df.schema).unionByName(free)
    listed = some["__key"].isin(names) if len(names) <= HOT_KEYS else None
    if listed is None:  # too many to list: a join tells them
        marked = some.join(hot, F.col("__key") == F.col("__hot"), "left")
        few, many = marked.filter("__hot IS NULL").drop("__hot"), marked.filter("__hot IS NOT NULL").drop("__hot")
    else:
        few, many = some.filter(~listed), some.filter(listed)
    return _streamed(few, order, ttl_ms, df.schema).unionByName(spread_arrivals(many, order, ttl_ms).select(*df.columns, "accepted")).unionByName(free)


def _streamed(some: DataFrame, order: str, ttl_ms: int, plain: T.StructType) -> DataFrame:
    """Arrivals with __key and __at, judged key by key in one stream for each task."""
    ordered = some.repartition("__key").sortWithinPartitions("__key", "__at", order)
    schema = T.StructType([*plain, T.StructField("accepted", T.BooleanType())])
    columns = plain.names

    def fold(batches):
        held, until = None, None
        for batch in batches:
            keys, times = batch.column(len(columns)), batch.column(len(columns) + 1)
            known = np.asarray(pc.is_valid(times))
            at = np.asarray(pc.fill_null(times, 0))
            codes = keys.dictionary_encode()
            names, code = codes.dictionary.to_pylist(), np.asarray(codes.indices)
            cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
            accepted = np.zeros(len(batch), bool)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if names[code[a]] != held:
                    held, until = names[code[a]], None
                i = a + int(np.searchsorted(known[a:b], True))  # those without an instant come first
                if until is not None:
                    i += int(np.searchsorted(at[i:b], until))
                while i < b:
                    accepted[i], until = True, int(at[i]) + ttl_ms
                    i = max(i + 1, i + int(np.searchsorted(at[i:b], until)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(accepted)], names=[*columns, "accepted"])

    return ordered.mapInArrow(fold, schema)


def _finals(t: np.ndarray, ttl_ms: int) -> np.ndarray:
    """For each of the sorted instants, until when its key is remembered in the end if it is the first one accepted."""
    follow = np.searchsorted(t, t + ttl_ms)
    follow = np.where(follow < len(t), follow, np.arange(len(t)))  # the last of a chain follows itself
    while True:  # each round doubles the steps
        further = follow[follow]
        if (further == follow).all():
            return t[follow] + ttl_ms
        follow = further


def spread_arrivals(some: DataFrame, order: str, ttl_ms: int = TTL_MS, slice_ms: int = SLICE_MS) -> DataFrame:
    """Arrivals with __key and __at, with accepted, however many a key has: no task takes more than a slice of time of a key.

    The different instants of a key in a slice, `slice_ms` at most, make a function: from the instant until which the key is remembered
    before the slice to that after it. A stream over the functions of a key's slices tells what each slice begins with; then every slice
    finds its accepted instants by itself, and of their arrivals the first in order counts.
    """
    instants = written(some.filter("__at IS NOT NULL").groupBy("__key", "__at").agg(F.min(order).alias("__first")))
    slices = written(instants.groupBy("__key", F.floor(F.col("__at") / slice_ms).alias("__slice")).agg(F.sort_array(F.collect_list("__at")).alias("t")))

    def functions(batches):
        for batch in batches:
            starts, ends = [], []
            for cell in batch.column("t"):
                t = cell.values.to_numpy()
                final = _finals(t, ttl_ms)
                last = np.append(final[1:] != final[:-1], True)  # of starts that end alike, the last
                starts.append(t[last].tolist())
                ends.append(final[last].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__slice"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["__key", "__slice", "starts", "ends"])

    made = slices.mapInArrow(functions, "__key string, __slice long, starts array<bigint>, ends array<bigint>")

    def composed(batches):
        held, until = None, None
        for batch in batches:
            before = []
            for i, name in enumerate(batch.column("__key").to_pylist()):
                if name != held:
                    held, until = name, None
                before.append(until)
                at = batch.column("starts")[i].values.to_numpy()
                k = 0 if until is None else int(np.searchsorted(at, until))
                if k < len(at):
                    until = batch.column("ends")[i].values[k].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__slice"), pa.array(before, pa.int64())], names=["__key", "__slice", "before"])

    begun = made.repartition("__key").sortWithinPartitions("__key", "__slice").mapInArrow(composed, "__key string, __slice long, before long")

    def chosen(batches):
        for batch in batches:
            keys, found = [], []
            for name, cell, until in zip(batch.column("__key").to_pylist(), batch.column("t"), batch.column("before").to_pylist(), strict=True):
                t = cell.values.to_numpy()
                i = 0 if until is None else int(np.searchsorted(t, until))
                while i < len(t):
                    keys.append(name)
                    found.append(int(t[i]))
                    i = int(np.searchsorted(t, t[i] + ttl_ms))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.int64())], names=["__key", "__at"])

    taken = slices.join(begun, ["__key", "__slice"]).select("__key", "t", "before").mapInArrow(chosen, "__key string, __at long")
    first = instants.join(taken, ["__key", "__at"]).select(F.col("__key").alias("__k"), F.col("__first").alias("__o"))
    out = some.join(first, (F.col("__key") == F.col("__k")) & (F.col(order) == F.col("__o")), "left")
    return out.withColumn("accepted", F.col("__k").isNotNull()).drop("__k", "__o")


def live_keys(entries: DataFrame, now_ms: int, max_keys: int = MAX_KEYS) -> DataFrame:
    """The entries (key, expires_at, insert_seq) that are not expired, the latest insertions up to the cap."""
    return entries.filter(F.col("expires_at") > now_ms).orderBy(F.col("insert_seq").desc()).limit(max_keys)


def unseen(requests: DataFrame, entries: DataFrame, key: str, instant: str) -> DataFrame:
    """The requests whose key is not in a live entry at their arrival."""
    hit = (F.col(key) == F.col("__key")) & (F.col("__until") > F.col(instant))
    return requests.join(entries.select(F.col("key").alias("__key"), F.col("expires_at").alias("__until")), hit, "left_anti")
