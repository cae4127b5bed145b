"""Idempotency as keyed state of a stream: each key's memory lives in the state store, with a time to live, and nothing is rewritten for keys that a batch doesn't touch."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulsefold.operators.repeats import TTL_MS

#: How long a key's state is kept after it was written, by the clock of the executors. A stream may lag behind its arrivals by this less the memory.
KEEP_MS = 24 * 3_600_000
#: The state store that keyed state with a time to live needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_starting = threading.Lock()


class Memory(StatefulProcessor):
    """Until when a key is remembered. Of a micro-batch's arrivals of a key only instants and order are held."""

    def __init__(self, ttl_ms: int, keep_ms: int) -> None:
        self.ttl_ms, self.keep_ms = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long", self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._extend(int(initialState["until"].max()))

    def _extend(self, until: int) -> None:
        held = self.until.get() if self.until.exists() else None
        self.until.update((until if held is None else max(held[0], until),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["at", "order"], kind="stable")
        at = every["at"].to_numpy()
        accepted = np.zeros(len(at), bool)
        until = self.until.get()[0] if self.until.exists() else None
        i = 0 if until is None else int(np.searchsorted(at, until))
        while i < len(at):
            accepted[i], until = True, int(at[i]) + self.ttl_ms
            i = max(i + 1, int(np.searchsorted(at, until)))
        if accepted.any():
            self._extend(until)
        yield pd.DataFrame({"order": every["order"].to_numpy(), "key": key[0], "at": at, "accepted": accepted})

    def close(self) -> None:
        pass


def accepted_stream(arrivals: DataFrame, key: str, instant: str, order: str, ttl_ms: int = TTL_MS, keep_ms: int = KEEP_MS, entries: DataFrame | None = None) -> DataFrame:
    """(order, key, at, accepted) of a stream of arrivals, by the rules of `repeats.accepted_arrivals`.

    An arrival counts unless an accepted one of its key came less than the memory before; a null or empty key always counts, one without an
    instant never. Micro-batches are taken as they come and the arrivals of one by instant and `order`, so the result is that of the whole table if no
    arrival comes in a later batch than a younger one of its key. `entries` (key, expires_at) are what is remembered before the first batch. Keys live on
    the disks of the state store until `keep_ms` after their last accepted arrival; their number has no cap.
    """
    if keep_ms < ttl_ms:
        raise ValueError("state must be kept as long as keys are remembered")
    made = arrivals.select(F.col(order).cast("long").alias("order"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(instant).cast("long").alias("at"))
    stateless = (F.col("key") == "") | F.col("at").isNull()
    plain = made.filter(stateless).withColumn("accepted", F.col("key") == "")
    first = None
    if entries is not None:
        known = entries.filter((F.length("key") > 0) & F.col("expires_at").isNotNull())
        first = known.groupBy("key").agg(F.max("expires_at").cast("long").alias("until")).groupBy("key")
    some = made.filter(~stateless).groupBy("key")
    judged = some.transformWithStateInPandas(Memory(ttl_ms, keep_ms), "order long, key string, at long, accepted boolean", "append", "ProcessingTime", first)
    return plain.unionByName(judged)


def start(accepted: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the stream as Parquet files; a restart with the same checkpoint goes on with the keys that were remembered.

    State that is out of time goes with or without traffic; with `available_now`, where batches without data would never end, it goes in batches with data.
    """
    conf = accepted.sparkSession.conf
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(not available_now).lower()}
    writer = accepted.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    with _starting:  # a query copies the settings when it starts
        before = {name: conf.get(name) for name in settings}
        try:
            for name, value in settings.items():
                conf.set(name, value)
            return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
        finally:
            for name, value in before.items():
                conf.set(name, value)
