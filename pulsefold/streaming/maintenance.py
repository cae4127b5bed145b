"""Maintenance of a store apart from its traffic: retention when it is due, and removal of what no reader holds."""

from __future__ import annotations

import time

from pyspark.sql.streaming import StreamingQuery

from pulsefold.sources.ledger import Conflict
from pulsefold.sources.store import Store

#: How long a burst of appends is let pass before the store is pruned for it, and how often age alone makes a prune due (fixed values).
DEBOUNCE_MS, SWEEP_MS = 60_000, 300_000


class Maintenance:
    """Prunes a store within its bounds.

    A prune is due `debounce_ms` after the appends since the last one came to `max_rows`, or, where there is an age bound, once
    `sweep_ms` went by. What it goes by stands in the store's versions: appends during a prune count for the next one, a restart forgets
    nothing, and of two prunes at once the second one finds its parts gone and gives up. A failed prune changes nothing and is tried again.
    """

    def __init__(self, store: Store, max_rows: int = 0, max_age_ms: int = 0, sweep_ms: int = SWEEP_MS, debounce_ms: int = DEBOUNCE_MS) -> None:
        self.store, self.max_rows, self.max_age_ms, self.sweep_ms, self.debounce_ms = store, max_rows, max_age_ms, sweep_ms, debounce_ms
        self._running = False

    def due(self, now_ms: int) -> bool:
        m = self.store.ledger.latest()
        swept = self.max_age_ms > 0 and m["swept_ms"] is not None and now_ms - m["swept_ms"] >= self.sweep_ms
        crossed = self.max_rows > 0 and m["crossed_ms"] is not None and now_ms - m["crossed_ms"] >= self.debounce_ms
        return bool(m["events"]) and (swept or crossed)

    def tick(self, now_ms: int) -> dict | None:
        """Prune if it is due; the report of the prune, if there was one."""
        if self._running or not self.due(now_ms):
            return None
        self._running = True
        try:
            return self.store.prune(now_ms, self.max_rows, self.max_age_ms)
        except Exception:  # the old version stays whole, and the next tick tries again
            return None
        finally:
            self._running = False

    def tidy(self, now_ms: int, grace_ms: int, started_at: int = 0) -> int:
        """Join small parts, leave out what no tally counts any more, and remove files that no reader holds."""
        try:
            self.store.compact()
            self.store.forget(started_at)
        except Conflict:  # another writer was faster; the next time does it
            pass
        return self.store.clean(now_ms, grace_ms)

    def start(self, checkpoint: str, every: str = "5 seconds", grace_ms: int = 3_600_000, started_at: int = 0, clock=lambda: int(time.time() * 1000)) -> StreamingQuery:
        """A timer as a streaming query of its own: each of its micro-batches is a tick, and they never overlap.

        Readers may hold a version for `grace_ms` after the next one came.
        """
        ticks = self.store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def run(_, __) -> None:
            self.tick(clock())
            self.tidy(clock(), grace_ms, started_at)

        return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
