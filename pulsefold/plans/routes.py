"""The read routes: a request target and the receiver's store in, one row with status and JSON body out."""

from __future__ import annotations

import hmac
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.functions.numbers import parameter_number
from pulsefold.functions.target import parameters
from pulsefold.operators.repeats import MAX_KEYS, TTL_MS
from pulsefold.sources.ndjson import filtered, typed, unreadable
from pulsefold.sources.scratch import temporary
from pulsefold.sources.store import Snapshot

from . import body, pages, summary, tallies
from .ingest import BEARER

#: Paths of the routes (fixed values).
SUMMARY_PATH, EVENTS_PATH, CAPABILITIES_PATH = "/summary", "/events", "/capabilities"
#: Parameters that filter both routes, by the names they have in a query string; `signature` filters events alone.
_FILTERS = {"type": "type", "platform": "platform", "appVersion": "app_version"}


@dataclass(frozen=True)
class State:
    """What the receiver knows besides its log; tables that are left out count as empty."""

    started_at: int
    version: str | None = None
    token: str | None = None
    outcomes: DataFrame | None = None
    prunes: DataFrame | None = None
    live_keys: DataFrame | None = None
    max_rows: int = 0
    max_age_ms: int = 0


def version_of(path: str) -> str | None:
    """The `version` of a JSON file, if it is a text that is not empty; null whatever else is wrong."""
    try:
        version = json.loads(Path(path).read_text()).get("version")
    except (OSError, ValueError, AttributeError):
        return None
    return version if isinstance(version, str) and version else None


def _tables(parts: DataFrame) -> dict[str, list[dict]]:
    """The rows of each axis; all axes have a bounded number of rows."""
    return {r["axis"]: json.loads(r["rows"]) for r in parts.collect()}


def summary_body(log: DataFrame | Snapshot, state: State, now_ms: int, query: dict[str, str] | None = None) -> dict:
    """The summary of the log's events that the query picks, with the receiver's state.

    `log` is a version of the store, or a parsed log, whose typed events are then written once and removed with the answer. Of a
    version, axes of labels come from the parts' rollups unless `since` is asked for, and no event is read for them.
    total, liveness, the tallies and unreadable are of the whole log and receiver, whatever the query picks.
    """
    query = query or {}
    since = parameter_number(query["since"]) if "since" in query else None
    bounded = since is not None and abs(since) < float("inf")
    chosen = {column: query.get(name) for name, column in _FILTERS.items()}
    if isinstance(log, Snapshot):
        labels = None if bounded else log.rollup(**chosen)
        tables = _tables(summary.document(log.events(since, **chosen), now_ms, labels))
        counts, last = {"total": log.total, "unreadable": log.unreadable}, log.last_instant
        spark = log.spark
    else:
        spark = log.sparkSession
        counts = unreadable(log).first().asDict()
        with temporary(typed(log)) as events:
            tables = _tables(summary.document(filtered(events, since=since, **chosen), now_ms))
            last = events.agg(F.max("instant")).first()[0]
    table = lambda df, schema: spark.createDataFrame([], schema) if df is None else df
    outcomes = tallies.since_start(table(state.outcomes, tallies.OUTCOME), state.started_at)
    prunes = tallies.since_start(table(state.prunes, tallies.PRUNE), state.started_at, "at_ms")
    now = F.lit(now_ms)
    blocks = {
        "liveness": tallies.liveness_row(spark.createDataFrame([(last,)], "last_accepted_at double"), outcomes, F.lit(state.started_at), now),
        "rejections": tallies.rejection_tally(outcomes, now),
        "persist_errors": tallies.persist_tally(outcomes, now),
        "retention": tallies.retention_tally(prunes, now, state.max_rows, state.max_age_ms),
        "deduped": tallies.dedup_tally(outcomes, now),
        "seen_keys": tallies.seen_key_tally(table(state.live_keys, tallies.ENTRY), *((0, 0) if state.live_keys is None else (MAX_KEYS, TTL_MS))),
    }
    rows = None
    for name, block in blocks.items():  # one row each
        row = block.select(F.lit(name).alias("name"), F.to_json(F.struct(*block.columns)).alias("row"))
        rows = row if rows is None else rows.unionByName(row)
    matched = sum(r["n"] for r in tables["matched"])
    own = {"total": counts["total"], "matched": matched, "unreadable": counts["unreadable"], "startedAt": state.started_at, "readAt": now_ms, "receiverVersion": state.version}
    return body.axes(tables, now_ms) | own | body.tallies({r["name"]: json.loads(r["row"]) for r in rows.collect()})


def page_body(log: DataFrame | Snapshot, query: dict[str, str]) -> dict:
    filters = {column: query.get(name) for name, column in (_FILTERS | {"signature": "signature"}).items()}
    page = pages.page(log, query.get("limit"), query.get("offset"), query.get("since"), **filters).first()
    return {"events": [json.loads(e) for e in page["events"]], **{c: page[c] for c in ("total", "matched", "limit", "offset")}}


def answer(spark: SparkSession, log: DataFrame | Snapshot, target: str, state: State, now_ms: int, method: str = "GET", authorization: str | None = None) -> DataFrame:
    """(status, body) for a GET of the summary, of a page of events, or of what is accepted.

    401 comes first, where the state has a token and `authorization` another or none; 400 and 404 are of the target, and 500 tells why the log
    can't be read.
    """
    told = lambda status, what: spark.createDataFrame([(status, body.encoded(what))], "status int, body string")
    if state.token:
        sent = re.match(BEARER.replace(r"\z", r"\Z"), authorization or "")
        if not sent or not hmac.compare_digest(sent[1].encode(), state.token.encode()):
            return told(401, {"error": "unauthorized"})
    parts = parameters(spark, target)
    if parts is None:
        return told(400, {"error": "invalid request-target"})
    path, query = parts
    for own, name, make in ((SUMMARY_PATH, "summary", lambda: summary_body(log, state, now_ms, query)), (EVENTS_PATH, "events", lambda: page_body(log, query))):
        if method == "GET" and path == own:
            try:
                return told(200, make())
            except Exception as e:  # whatever keeps the log from being read, who asks is told
                return told(500, {"error": f"could not read {name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}"})
    if method == "GET" and path == CAPABILITIES_PATH:
        own = pages.capabilities(spark, bool(state.token)).first()
        return told(200, {"schemaVersion": own["schema_version"], "acceptedSchemaVersions": own["accepted_versions"], "authRequired": own["auth"]})
    return told(404, {"error": "not found"})
