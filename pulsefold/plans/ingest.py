"""Admission of request batches: ordered gates, all-or-nothing validation, idempotency, and the events that enter the log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefold.functions import validation
from pulsefold.functions import variant as V
from pulsefold.functions.target import parts
from pulsefold.operators.repeats import TTL_MS, accepted_arrivals, unseen
from pulsefold.sources.scratch import written

#: Columns of a request.
REQUEST = "seq long, arrived_at_ms long, method string, target string, headers map<string,string>, body binary"
#: Route of a batch, and the headers that carry its schema version and idempotency key (fixed values).
ROUTE, VERSION_HEADER, KEY_HEADER = ("POST", "/ingest"), "x-telemetry-schema", "idempotency-key"
#: How a token is sent.
BEARER = r"(?i)^Bearer\s+(\S+)\s*\z"
#: Largest body in bytes (fixed value).
MAX_BODY = 1 << 20


@dataclass(frozen=True)
class Settings:
    """What a receiver asks of requests; without a token it asks for none."""

    token: str | None = None
    max_body: int = MAX_BODY
    accepted: tuple[int, ...] = validation.ACCEPTED
    ttl_ms: int = TTL_MS


#: What is told of a refusal, by status and, for the two kinds of 400, by gate.
REASONS = {401: "no or another token", 404: "no such route", 415: "schema version not accepted", 413: "body too large", 422: "batch not valid", 503: "events not stored"}
NO_TARGET, NO_BATCH, NO_BODY = "request target not readable", "body is no batch", "body not readable"


def first_status(gates: dict[int, Column] | list[tuple[int, Column]], accepted: int = 202) -> Column:
    """The status of the first gate, in order, that refuses a request."""
    out = None
    for status, refused in gates.items() if isinstance(gates, dict) else gates:
        refused = F.coalesce(refused, F.lit(False))
        out = F.when(refused, status) if out is None else out.when(refused, status)
    return F.lit(accepted) if out is None else out.otherwise(accepted)


def header(name: str) -> Column:
    """A header by its name in lower case, whatever case it was sent in."""
    lowered = F.transform_keys("headers", lambda k, _: F.lower(k))
    return F.try_element_at(lowered, F.lit(name))


def _opened(requests: DataFrame) -> DataFrame:
    """`requests` with events, those in the body."""
    return requests.withColumn("__parsed", V.parse_strict(F.decode("body", "UTF-8"))).withColumn("events", V.elements(V.field(F.col("__parsed"), "events"))).drop("__parsed")


def judged(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`requests` with declared, key, events (array<variant>), the status before idempotency, which is that of the first
    gate that refuses, and its reason (null if none does).

    Header names may not repeat in other case. A null body is one that could not be read to its end; `max_body` 0 bounds none. A batch is valid if each event carries the declared version and
    is valid in it; an empty one is. The version inside the body is not read, only its events are.
    """
    versions = sorted({*settings.accepted, validation.VERSION})
    read = requests.withColumn("declared", header(VERSION_HEADER)).withColumn("key", header(KEY_HEADER))
    read = _opened(read.withColumn("path", parts(F.col("target"))["path"]))
    valid = validation.all_valid(F.col("events"), F.col("declared").cast("int"))
    token = F.regexp_extract(F.coalesce(header("authorization"), F.lit("")), BEARER, 1)
    no_target = F.col("path").isNull()
    gates: list[tuple[int, Column]] = [(401, token != settings.token)] if settings.token else []
    gates += [
        (400, no_target),
        (404, (F.col("method") != ROUTE[0]) | (F.col("path") != ROUTE[1])),
        (415, F.col("declared").isNull() | ~F.col("declared").isin(*map(str, versions))),
        *([(413, (F.try_to_number(header("content-length"), F.lit("999999999999999")) > settings.max_body) | (F.octet_length("body") > settings.max_body))] if settings.max_body > 0 else []),
        (400, F.col("events").isNull()),
        (422, ~valid),
    ]
    told = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    reason = F.when(F.col("status") == 400, F.when(no_target, NO_TARGET).when(F.col("body").isNull(), NO_BODY).otherwise(NO_BATCH)).otherwise(F.try_element_at(told, F.col("status")))
    return read.withColumn("status", first_status(gates)).withColumn("reason", reason).drop("path")


def verdicts(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(seq, arrived_at_ms, declared, key, status, reason, size): `judged` without what the requests hold, so it is small enough to be kept."""
    return judged(requests, settings).select("seq", "arrived_at_ms", "declared", "key", "status", "reason", F.size("events").alias("size"))


def told(verdicts: DataFrame, seen: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """`verdicts`, which are read several times, with deduped and accepted, the number of events that enter the log.

    A request that passes every gate is a repeat if its key is live in `seen` (key, expires_at) when it arrives,
    or if an accepted request of this table had the key less than the TTL before. Refused requests leave no key.
    """
    passed = verdicts.filter("status = 202")
    fresh = passed if seen is None else unseen(passed, seen, "key", "arrived_at_ms")
    first = accepted_arrivals(fresh.select("seq", "key", "arrived_at_ms"), "key", "arrived_at_ms", "seq", settings.ttl_ms).filter("accepted").select("seq", F.lit(True).alias("__first"))
    out = verdicts.join(first, "seq", "left")
    return out.withColumn("deduped", (F.col("status") == 202) & F.col("__first").isNull()).withColumn("accepted", F.when(F.col("__first"), F.col("size")).otherwise(0)).drop("__first", "size")


def outcomes(requests: DataFrame, seen: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """What is told of each request, see `told`. Bodies are read and judged once."""
    return told(written(verdicts(requests, settings)), seen, settings)


def admitted(requests: DataFrame, seen: DataFrame | None = None, settings: Settings = Settings(), known: DataFrame | None = None) -> DataFrame:
    """`judged` with deduped and accepted; `seq` tells requests apart. `known` are their outcomes, if they were told before.

    Bodies cross the network, not the larger events.
    """
    return _opened(requests.drop("arrived_at_ms").join(outcomes(requests, seen, settings) if known is None else known, "seq"))


def not_stored(outcomes: DataFrame) -> DataFrame:
    """The outcomes when the events can't be written: who sent them is told to send them again, and leaves no key."""
    lost = (F.col("status") == 202) & ~F.col("deduped")
    return outcomes.withColumns({"reason": F.when(lost, REASONS[503]).otherwise(F.col("reason")), "accepted": F.when(lost, 0).otherwise(F.col("accepted")), "status": F.when(lost, 503).otherwise(F.col("status"))})


def log_rows(outcomes: DataFrame) -> DataFrame:
    """(request, position, event, instant, value): the events of accepted requests, stamped with their arrival.

    The stamp replaces any receivedAt that was sent.
    """
    each = outcomes.filter("accepted > 0").select("seq", "arrived_at_ms", F.posexplode("events").alias("position", "event"))
    # the object is written again without an old stamp
    members = F.map_filter(F.col("event").cast("map<string,variant>"), lambda k, _: k != "receivedAt")
    stamped = F.map_concat(members, F.create_map(F.lit("receivedAt"), F.parse_json(F.col("arrived_at_ms").cast("string"))))
    return each.select(F.col("seq").alias("request"), "position", F.col("arrived_at_ms").cast("double").alias("instant"), F.to_json(stamped).alias("value"))


def live_entries(outcomes: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """(key, expires_at, insert_seq) of the keys that accepted requests leave."""
    kept = outcomes.filter((F.col("status") == 202) & ~F.col("deduped") & (F.length("key") > 0))
    return kept.select("key", (F.col("arrived_at_ms") + ttl_ms).alias("expires_at"), F.col("seq").alias("insert_seq"))
