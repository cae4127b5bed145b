"""The receiver as a stream: request files in; events, outcomes and live keys out, in one version of the store for each batch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsefold.functions.numbers import retention_setting
from pulsefold.operators.repeats import live_keys
from pulsefold.plans.ingest import MAX_BODY, REQUEST, Settings, admitted, live_entries, log_rows, not_stored, told, verdicts
from pulsefold.plans.routes import State, answer, version_of
from pulsefold.plans.tallies import ENTRY, OUTCOME, PRUNE
from pulsefold.sources.scratch import temporary
from pulsefold.sources.store import Store

from .maintenance import DEBOUNCE_MS, SWEEP_MS, Maintenance


def request_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Requests from Parquet files as they arrive; the number of files in a micro-batch is bounded."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).parquet(folder)


#: Bounds of the store unless the environment says otherwise (fixed values).
MAX_EVENTS, MAX_AGE_HOURS = 10_000, 0


class Receiver:
    """Admits micro-batches, and keeps the store within its bounds.

    A micro-batch writes its events, its outcomes and the keys that are live after it as files of their own, and commits all three
    by one version under its number. Until then no reader sees any of them, and a further run of a committed batch
    does nothing; so a run that ends between any two steps leaves no row, and the next one begins anew. If the events can't be written,
    the batch's requests are told so (503), and none of them is stored.

    Retention is `maintenance`: it runs after a batch if it is due, and by its own timer (`start_maintenance`) without traffic, too.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings(), max_rows: int = 0, max_age_ms: int = 0, sweep_ms: int = SWEEP_MS, debounce_ms: int = 0, version: str | None = None) -> None:
        self.spark, self.folder, self.settings, self.version = spark, folder, settings, version
        self.store = Store(spark, folder)
        self.started_at = int(time.time() * 1000)
        self.maintenance = Maintenance(self.store, max_rows, max_age_ms, sweep_ms, debounce_ms)

    def batch(self, requests: DataFrame, number: int) -> None:
        before = self.store.snapshot()
        done = before.manifest["batch"]
        if number <= done:
            return
        if number != done + 1:
            raise ValueError(f"the keys of batch {number - 1} are not there")
        seen = before.keys(ENTRY).filter((F.length("key") > 0) & F.col("expires_at").isNotNull())
        with temporary(verdicts(requests, self.settings)) as judged:
            now = self._commit(requests, judged, seen, number)
        self.maintenance.tick(now or 0)

    def _commit(self, requests: DataFrame, judged: DataFrame, seen: DataFrame, number: int) -> int | None:
        """Write and commit what a batch leaves, and say when its last request came. Only the outcomes are kept meanwhile; events are read from the requests."""
        outcomes = told(judged, seen, self.settings).persist()
        written: list[str] = []
        part = None
        try:
            rows = log_rows(admitted(requests, known=outcomes))
            final = outcomes
            try:
                part = self.store.part(rows.select((F.shiftleft(F.col("request"), 16) + F.col("position")).alias("seq"), "value"))
            except Exception:  # whatever kept the events from the log, their senders keep them
                final = not_stored(outcomes)
            now, first, count = final.agg(F.max("arrived_at_ms"), F.min("arrived_at_ms"), F.count("*")).first()
            written.append(self.store.write(final.select(*[c.split(" ")[0] for c in OUTCOME.split(", ")]), "outcomes"))
            keys = live_keys(seen.unionByName(live_entries(final, self.settings.ttl_ms)), now or 0)
            written.append(self.store.write(keys, "keys"))
            self.store.commit(part, number, now or 0, self.maintenance.max_rows, {"path": written[0], "rows": count, "last_ms": now}, {"path": written[1]})
        except BaseException:
            for path in written:
                self.store.files.remove(path)
            if part:
                self.store.drop(part)
            raise
        finally:
            outcomes.unpersist()
        return now

    def start(self, requests: DataFrame, available_now: bool = False) -> StreamingQuery:
        writer = requests.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()

    def start_maintenance(self, every: str = "5 seconds", grace_ms: int = 3_600_000) -> StreamingQuery:
        """Retention and cleaning by a timer of their own."""
        return self.maintenance.start(f"{self.folder}/timer-{uuid.uuid4().hex}", every, grace_ms, self.started_at)

    def answer(self, target: str, now_ms: int, method: str = "GET", authorization: str | None = None) -> DataFrame:
        """(status, body) of a read route, from one version of the store: its events, outcomes, keys and prunes belong together."""
        at = self.store.snapshot()
        m = self.maintenance
        state = State(self.started_at, self.version, self.settings.token, at.outcomes(OUTCOME), at.prunes(PRUNE), at.keys(ENTRY), m.max_rows, m.max_age_ms)
        return answer(self.spark, at, target, state, now_ms, method, authorization)

    def outcomes(self) -> DataFrame:
        return self.store.snapshot().outcomes(OUTCOME)

    def prunes(self) -> DataFrame:
        return self.store.snapshot().prunes(PRUNE)

    def live(self, number: int) -> DataFrame:
        """The keys that are live after batch `number`, the last one."""
        at = self.store.snapshot()
        if at.manifest["batch"] != number:
            raise ValueError(f"the last batch is {at.manifest['batch']}")
        return at.keys(ENTRY)


def from_environment(spark: SparkSession, folder: str, environment: Mapping[str, str], version_file: str | None = None) -> Receiver:
    """A receiver with the settings of an environment: AUTH_TOKEN, STORE_MAX_EVENTS, STORE_MAX_AGE_HOURS and INGEST_MAX_BODY_BYTES.

    A bound that is not there, blank, malformed or negative is the usual one; 0 switches it off. An empty token asks for none. The keys that
    were live before a restart are in the store, and so is when it was last pruned.
    """
    bound = lambda name, usual: retention_setting(environment.get(name), usual)
    settings = Settings(token=environment.get("AUTH_TOKEN") or None, max_body=int(bound("INGEST_MAX_BODY_BYTES", MAX_BODY)))
    rows, hours = int(bound("STORE_MAX_EVENTS", MAX_EVENTS)), bound("STORE_MAX_AGE_HOURS", MAX_AGE_HOURS)
    return Receiver(spark, folder, settings, rows, int(hours * 3_600_000), debounce_ms=DEBOUNCE_MS, version=version_of(version_file) if version_file else None)
