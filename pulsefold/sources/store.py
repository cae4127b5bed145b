"""The store of events: parts of typed columns, with what the receiver keeps beside them, under one ledger.

A part is a Parquet table by day of the event's instant, with bloom filters, and a rollup of its labels. The manifest has
for each part its rows and its ranges of arrival and instant, so that a read opens the parts it needs, and a page counts
without reading. Events, outcomes, live keys and prunes of a batch become visible together, by one manifest; files that no manifest
names are no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefold.functions import variant as V
from pulsefold.functions.schema import struct_of
from pulsefold.operators.retention import nth_latest
from pulsefold.operators.rollup import COLUMNS as ROLLUP
from pulsefold.operators.rollup import rollup

from .ledger import Conflict, Files, Ledger
from .ndjson import filtered, ordered_lines, parsed, typed
from .scratch import scratch_folder

#: Width of the partitions by instant.
DAY_MS = 86_400_000
#: Columns that reads look single values up in.
LOOKED_UP = ("signature", "type", "app_version")

SCHEMA = struct_of(
    "seq long, event variant, type string, runtime string, platform string, app_version string, schema_version string, schema_number double, instant double, "
    "signature string, error_name string, reason string, source string, lag double, day long"
)
#: The version of a store without a commit.
EMPTY = {"batch": -1, "events": [], "outcomes": [], "keys": None, "prunes": [], "appended": 0, "crossed_ms": None, "swept_ms": None, "next_seq": 0}


@dataclass(frozen=True)
class Snapshot:
    """One version of the store. It stays readable as long as `Store.clean` leaves its files."""

    spark: SparkSession
    folder: str
    manifest: dict = field(repr=False)

    @property
    def parts(self) -> list[dict]:
        return self.manifest["events"]

    @property
    def rows(self) -> int:
        return sum(p["rows"] for p in self.parts)

    @property
    def total(self) -> int:
        """JSON values of the log, whatever their kind."""
        return sum(p["rows"] + p["others"] for p in self.parts)

    @property
    def unreadable(self) -> int:
        return sum(p["unreadable"] for p in self.parts)

    @property
    def last_instant(self) -> float | None:
        return max((p["high_instant"] for p in self.parts if p["high_instant"] is not None), default=None)

    def table(self, paths: list[str], schema: T.StructType, base: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{base}")
        return read.parquet(*[f"{self.folder}/{p}" for p in paths]).select(*schema.names)

    def of(self, parts: list[dict]) -> DataFrame:
        """The events of some parts."""
        return self.table([p["path"] for p in parts], SCHEMA, "events")

    def events(self, since: float | None = None, **filters: str | None) -> DataFrame:
        """The typed events that meet all filters, from the parts and days that can have some."""
        bounded = since is not None and abs(since) < float("inf")
        parts = [p for p in self.parts if not bounded or (p["high_instant"] is not None and p["high_instant"] >= since)]
        out = self.of(parts)
        if bounded:
            out = out.filter(F.col("day") >= int(since // DAY_MS))
        return filtered(out, since=since, **filters)

    def rollup(self, **filters: str | None) -> DataFrame:
        """The labels of all events with their counts, from the parts' rollups, that meet the filters by type, platform and version."""
        return filtered(self.table([p["rollup"] for p in self.parts], ROLLUP, "rollups"), **filters)

    def outcomes(self, schema: str) -> DataFrame:
        return self.table([p["path"] for p in self.manifest["outcomes"]], struct_of(schema), "outcomes")

    def keys(self, schema: str) -> DataFrame:
        held = self.manifest["keys"]
        return self.table([held["path"]] if held else [], struct_of(schema), "keys")

    def prunes(self, schema: str) -> DataFrame:
        rows = [tuple(p.values()) for p in self.manifest["prunes"]]
        return self.spark.createDataFrame(rows, schema)


class Store:
    """Events below a folder.

    An append with a `number` counts once, however often it is tried. Writers of one folder can run side by side: who comes
    second builds on the version of the first, and starts again only if that one took away what it had read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.files = Files(spark, folder)
        self.ledger = Ledger(self.files, EMPTY)

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.folder, self.ledger.latest())

    def read(self) -> DataFrame:
        return self.snapshot().events()

    # writing

    def write(self, table: DataFrame, kind: str) -> str:
        """The table as files of their own, which no version names yet."""
        path = f"{kind}/part={uuid.uuid4().hex}"
        try:
            table.write.parquet(f"{self.folder}/{path}")
        except BaseException:
            self.files.remove(path)
            raise
        return path

    def _part(self, events: DataFrame, others: int = 0, unreadable: int = 0) -> dict:
        """Write typed events as a part that no version names yet."""
        path = f"events/part={uuid.uuid4().hex}"
        try:
            day = F.floor(F.col("instant") / DAY_MS).cast("long")
            # a day's rows meet, and large days are split: else each task has a file for each day, and there are more of both in a larger log
            dated = events.withColumn("day", day).select(*SCHEMA.names).hint("rebalance", "day").sortWithinPartitions("day", "type", "seq")
            # bloom filters are as large as their values need, not of one size for every file
            writer = dated.write.option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("day")
            for c in LOOKED_UP:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.candidates.number#{c}", 12)
            writer.parquet(f"{self.folder}/{path}")
            back = Snapshot(self.spark, self.folder, EMPTY).of([{"path": path}])
            low = F.min("seq"), F.max("seq"), F.min("instant"), F.max("instant"), F.count_if(F.col("instant").isNull())
            rows, *found = back.agg(F.count("*"), *low).first()
            names = ("low_seq", "high_seq", "low_instant", "high_instant", "undated")
            return {"path": path, "rollup": self.write(rollup(back), "rollups"), "rows": rows, "others": others, "unreadable": unreadable} | dict(zip(names, found, strict=True))
        except BaseException:
            self.files.remove(path)
            raise

    def part(self, events: DataFrame) -> dict:
        """Write events (seq, value), each value a JSON object, as a part that no version names yet."""
        log = events.select(F.col("seq").cast("long").alias("seq"), "value").withColumn("event", V.parse_strict(F.col("value")))
        return self._part(typed(log))

    def drop(self, part: dict) -> None:
        """Remove a part that no version names."""
        for path in (part["path"], part["rollup"]):
            self.files.remove(path)

    def append(self, events: DataFrame, number: int | None = None) -> None:
        """Add events (seq, value) whole or not at all; with a `number`, once however often it is called."""
        if number is not None and number <= self.ledger.latest()["batch"]:
            return
        part = self.part(events)
        try:
            self.commit(part, number)
        except BaseException:
            self.drop(part)
            raise

    def commit(self, part: dict | None, number: int | None = None, now_ms: int = 0, max_rows: int = 0, outcomes: dict | None = None, keys: dict | None = None, last_seq: int | None = None) -> dict:
        """Make a part visible, together with what belongs to its batch; nothing if a batch of this number is.

        `crossed_ms` notes when the events appended since the last prune came to `max_rows`.
        """

        def make(m: dict) -> dict | None:
            if number is not None and number <= m["batch"]:
                return None
            m["batch"] = m["batch"] if number is None else number
            if part is not None and (part["rows"] or part["others"] or part["unreadable"]):
                m["events"].append(part)
                m["appended"] += part["rows"]
            lasts = [x for x in (last_seq, part and part["high_seq"]) if x is not None]
            m["next_seq"] = max([m["next_seq"], *(x + 1 for x in lasts)])
            m["outcomes"] += [outcomes] if outcomes else []
            m["keys"] = keys or m["keys"]
            m["swept_ms"] = now_ms if m["swept_ms"] is None else m["swept_ms"]
            if max_rows > 0 and m["appended"] >= max_rows and m["crossed_ms"] is None:
                m["crossed_ms"] = now_ms
            return m

        return self.ledger.change(make)

    def load(self, path: str) -> None:
        """Add the lines of NDJSON files in their order; `unreadable` and `total` count what is no event."""
        lines = ordered_lines(self.spark, path, self.ledger.latest()["next_seq"])
        log = parsed(lines, F.col("seq"))
        e = F.col("event")
        lost, others = log.agg(F.count_if(e.isNull()), F.count_if(e.isNotNull() & ~(V.is_object(e) | V.is_array(e)))).first()
        last = lines.agg(F.max("seq")).first()[0]
        part = self._part(typed(log), others, lost)
        try:
            self.commit(part, last_seq=last)
        except BaseException:
            self.drop(part)
            raise

    # retention

    def prune(self, now_ms: int, max_rows: int = 0, max_age_ms: float = 0, keep: bool = True) -> dict:
        """Apply retention and report before, after, pruned and rewrote; a log that is written anew holds events alone.

        Parts that go whole are only named no more, and parts that stay whole are not read; of those that are cut the rows that
        stay become one new part. `keep` notes the prune in the version.
        """
        seen = self.snapshot()
        least = now_ms - max_age_ms if max_age_ms > 0 else None
        whole, cut = [], []
        for p in seen.parts:
            if least is None or p["low_instant"] is None or p["low_instant"] >= least:
                whole.append(p)
            elif p["undated"] or p["high_instant"] >= least:
                cut.append(p)
        young = F.lit(True) if least is None else F.col("instant").isNull() | (F.col("instant") >= least)
        edge = None
        if max_rows > 0:
            left = {p["path"]: p["rows"] for p in whole}
            for p in cut:
                left[p["path"]] = seen.of([p]).filter(young).count()
            if sum(left.values()) > max_rows:
                edge = self._edge(seen, [*whole, *cut], left, young, max_rows)
                cut = [p for p in [*cut, *whole] if p["high_seq"] >= edge and (p in cut or p["low_seq"] < edge)]
                whole = [p for p in whole if p["low_seq"] >= edge]
        new = None
        if cut:
            stays = seen.of(cut).filter(young)
            new = self._part((stays if edge is None else stays.filter(F.col("seq") >= edge)).drop("day"))
        before, after = seen.rows, sum(p["rows"] for p in whole) + (new["rows"] if new else 0)
        report = {"before": before, "after": after, "pruned": before - after, "rewrote": before != after}
        kept, known = {p["path"] for p in whole}, {p["path"] for p in seen.parts}

        def make(m: dict) -> dict | None:
            there = {p["path"] for p in m["events"]}
            if not known <= there:
                raise Conflict("another prune has taken parts away")
            if report["rewrote"]:
                stay = [p | ({"others": 0, "unreadable": 0} if p["path"] in known else {}) for p in m["events"] if p["path"] not in known - kept]
                m["events"] = stay + ([new] if new and new["rows"] else [])
            m["appended"] -= seen.manifest["appended"]
            m["swept_ms"], m["crossed_ms"] = now_ms, now_ms if max_rows > 0 and m["appended"] >= max_rows else None
            m["prunes"] += [{"at_ms": now_ms} | report] if keep else []
            return m

        try:
            if seen.parts:
                self.ledger.change(make)
        except BaseException:
            if new:
                self.drop(new)
            raise
        if new and not report["rewrote"]:
            self.drop(new)
        return report

    def _edge(self, seen: Snapshot, parts: list[dict], left: dict[str, int], young, max_rows: int) -> int:
        """The arrival number of the oldest of the `max_rows` latest events: ranges of arrival tell in which part it is, if they lie apart."""
        parts = sorted((p for p in parts if left[p["path"]]), key=lambda p: -p["high_seq"])
        apart = all(a["low_seq"] > b["high_seq"] for a, b in zip(parts, parts[1:], strict=False))
        rest = max_rows
        while apart and left[parts[0]["path"]] < rest:
            rest -= left[parts.pop(0)["path"]]
        return nth_latest(seen.of(parts[:1] if apart else parts).filter(young), "seq", rest)

    def compact(self, parts: int = 64) -> bool:
        """Make one part of all, once there are more than `parts`, and one table of all outcomes; true if it did."""
        seen = self.snapshot()
        old, tables = seen.parts, seen.manifest["outcomes"]
        if len(old) <= parts and len(tables) <= parts:
            return False
        many = len(old) > parts
        new = self._part(seen.of(old).drop("day"), sum(p["others"] for p in old), sum(p["unreadable"] for p in old)) if many else None
        told = None
        if len(tables) > parts:
            one = self.spark.read.option("basePath", f"{self.folder}/outcomes").parquet(*[f"{self.folder}/{p['path']}" for p in tables]).drop("part")
            told = {"path": self.write(one, "outcomes"), "rows": sum(p["rows"] for p in tables), "last_ms": max((p["last_ms"] for p in tables if p["last_ms"] is not None), default=None)}
        gone = {p["path"] for p in [*(old if many else []), *(tables if told else [])]}

        def make(m: dict) -> dict:
            if not gone <= {p["path"] for p in [*m["events"], *m["outcomes"]]}:
                raise Conflict("parts were taken away")
            m["events"] = ([new] if new else []) + [p for p in m["events"] if p["path"] not in gone]
            m["outcomes"] = ([told] if told else []) + [p for p in m["outcomes"] if p["path"] not in gone]
            return m

        self.ledger.change(make)
        return True

    def clean(self, now_ms: int, grace_ms: int) -> int:
        """Remove what no reader holds, and say how many folders went: versions that had a successor for `grace_ms`, and files that no version left names and that are as old."""
        numbers = self.ledger.numbers()
        if not numbers:
            return 0
        order = sorted(numbers)
        old = [v for v, after in zip(order, order[1:], strict=False) if numbers[after] <= now_ms - grace_ms]
        for v in old:
            self.files.remove(f"manifests/{v:020d}.json")
        named: set[str] = set()
        for v in set(order) - set(old):
            m = self.ledger.read(v)
            named |= {p[c] for p in m["events"] for c in ("path", "rollup")} | {p["path"] for p in m["outcomes"]} | ({m["keys"]["path"]} if m["keys"] else set())
        gone = 0
        for kind in ("events", "rollups", "outcomes", "keys"):
            for name, at in self.files.listed(kind).items():
                if name.startswith("part=") and f"{kind}/{name}" not in named and at <= now_ms - grace_ms:
                    self.files.remove(f"{kind}/{name}")
                    gone += 1
        return gone

    def forget(self, before_ms: int) -> None:
        """Leave out the prunes and, by table, the outcomes of before a time; tallies begin with the receiver's start."""

        def make(m: dict) -> dict | None:
            prunes = [p for p in m["prunes"] if p["at_ms"] >= before_ms]
            outcomes = [p for p in m["outcomes"] if p["last_ms"] is None or p["last_ms"] >= before_ms]
            if len(prunes) == len(m["prunes"]) and len(outcomes) == len(m["outcomes"]):
                return None
            return m | {"prunes": prunes, "outcomes": outcomes}

        self.ledger.change(make)



def scratch_store(spark: SparkSession) -> Store:
    """An empty store that goes when the application ends."""
    return Store(spark, scratch_folder(spark))
