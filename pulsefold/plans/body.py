"""The JSON bodies of the read routes, from tables of bounded size. Names of members are fixed values, as clients read them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pulsefold.functions.validation import INTRODUCED
from pulsefold.operators.grid import BUCKETS, WINDOW_MS

Rows = list[dict]
_STATS = {"n": "count", "low": "min", "mean": "avg", "high": "max"}
_SHAPE = ("workspaces", "panesOpen", "panesActive", "chats", "peakPanesOpen", "peakChats")


def _named(row: dict, names: dict[str, str]) -> dict:
    """Members of a row under other names; what is missing is null."""
    return {new: row.get(old) for old, new in names.items()}


def _by(rows: Rows, key: str, value: Callable[[dict], object] | str) -> dict:
    return {r[key]: r.get(value) if isinstance(value, str) else value(r) for r in rows}


def _number(x: float | None) -> float | int | None:
    return int(x) if isinstance(x, float) and x.is_integer() else x


def grid(rows: Rows, width_ms: int = WINDOW_MS // BUCKETS) -> dict:
    """A timeline: the buckets that hold something, in order."""
    return {"buckets": [_named(r, {"bucket_start": "bucketStart", "bucket_end": "bucketEnd", "n": "count"}) for r in sorted(rows, key=lambda r: r["bucket_start"])], "bucketMs": width_ms}


def stall_grid(rows: Rows, now_ms: int) -> dict:
    width = WINDOW_MS // BUCKETS
    out: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r["bucket"], str(r["source"]))):
        start = now_ms - WINDOW_MS + r["bucket"] * width
        cell = out.setdefault(r["bucket"], {"bucketStart": start, "bucketEnd": start + width, "count": 0, "max": None, "bySource": {}})
        cell["count"] += r["n"]
        if r.get("high") is not None:
            cell["max"] = r["high"] if cell["max"] is None else max(cell["max"], r["high"])
        if r["source"]:
            cell["bySource"][r["source"]] = {"count": r["n"], "max": _number(r.get("high"))}
    for cell in out.values():
        cell["max"] = _number(cell["max"])
    return {"buckets": list(out.values()), "bucketMs": width}


def _latency(r: dict) -> dict:
    return {"boundaries": r.get("boundaries") or [], "buckets": r.get("buckets") or [], "histogramCount": r["n"], "excludedCount": r["excluded"], **{p: r.get(p) for p in ("p50", "p95", "p99")}}


def _memory(r: dict) -> dict:
    out = {"windowsSeen": r["windows"], "samples": r.get("samples") or 0} | _named(r, {"low": "rssMinBytes", "mean": "rssAvgBytes", "high": "rssMaxBytes", "heap": "heapUsedMaxBytes"})
    names = {"mid": "rssAvgBytes", "high": "rssMaxBytes", "age": "processAgeMs", "ended": "windowEndedAt"}
    peak, latest = r.get("peak"), r.get("latest")
    return out | {"peak": peak and _named(peak, {k: v for k, v in names.items() if k != "mid"}), "latest": latest and _named(latest, names)}


def axes(tables: dict[str, Rows], now_ms: int) -> dict:
    """The members of the summary that come from the events, from the rows of each axis."""
    one = lambda name: (tables[name] or [{}])[0]
    counts = lambda name, key: _by(tables[name], key, "n")
    windows = {r["type"]: r for r in tables["windows"]}
    seen = lambda kind: windows.get(kind, {}).get("windows", 0)
    last = lambda kind: windows.get(kind, {}).get("last_ended")
    stats = lambda r: _named(r, _STATS)
    shapes = {r["measure"]: r for r in tables["workspaceShape"]}
    names, latest, made = tables["workspaceNames"], one("workspaceLatest"), one("generatedShaped")
    return {
        "byType": {t: counts("byType", "type").get(t, 0) for t in INTRODUCED},
        "firstSeen": one("seen").get("first_seen"),
        "lastSeen": one("seen").get("last_seen"),
        "topErrorNames": [{"name": r["name"], "count": r["n"]} for r in sorted(tables["topErrorNames"], key=lambda r: (-r["n"], r["name"]))],
        "topSignatures": [{"signature": r["signature"], "type": r["type"], "count": r["n"]} for r in sorted(tables["topSignatures"], key=lambda r: (-r["n"], r["signature"]))],
        "schemaVersions": counts("schemaVersions", "schema_version"),
        "appVersions": counts("appVersions", "app_version"),
        "platforms": counts("platforms", "platform"),
        "byRuntime": counts("byRuntime", "runtime"),
        "crashReasons": counts("crashReasons", "reason"),
        "stalls": stats(one("stalls")) | {"bySource": _by(tables["stallsBySource"], "source", stats)},
        "operations": _by(tables["operations"], "name", lambda r: _named(r, {"n": "count", "ok": "okCount", "fail": "failCount", "low": "min", "mean": "avg", "high": "max"})),
        "operationLatency": _by(tables["operationLatency"], "name", _latency),
        "operationRejections": {
            "windowsSeen": seen("operational-metrics"),
            "byRuntime": _by(tables["operationRejections"], "runtime", lambda r: _named(r, {"windows": "windowsSeen", "with_rejections": "windowsWithRejections", "rejected": "rejectedTotal", "stale": "rejectedStaleTotal", "invalid": "rejectedInvalidTotal", "last_rejected_at": "lastRejectedAt"})),
        },
        "workspaceShape": {
            "windowsSeen": seen("workspace-shape"),
            "lastSnapshotAt": last("workspace-shape"),
            "counts": {m: {"windowsSeen": 0, "avg": 0} | {new: shapes.get(m, {"windows": 0, "mean": 0}).get(old) for old, new in (("windows", "windowsSeen"), ("low", "min"), ("mean", "avg"), ("high", "max"))} for m in _SHAPE},
        },
        "workspaceNames": {
            "windowsSeen": seen("workspace-names"),
            "names": _by(names, "name", "windows"),
            "distinctCount": len(names),
            "maxChatCount": latest.get("max_chat_count"),
            "lastChatCount": latest.get("last_chat_count"),
            "truncatedEver": latest.get("truncated_ever", False),
            "generatedShaped": {"distinctCount": made.get("generated", 0), "considered": made.get("considered", 0), "share": made.get("share")},
            "lastSnapshotAt": latest.get("last_snapshot_at"),
        },
        "featureUsage": {
            "windowsSeen": seen("feature-usage"),
            "lastWindowAt": last("feature-usage"),
            "features": _by(tables["featureUsage"], "name", lambda r: {"count": r["uses"], "windowsSeen": r["windows"]}),
            "distinctCount": len(tables["featureUsage"]),
        },
        "processMemory": {"windowsSeen": seen("process-memory"), "lastWindowAt": last("process-memory"), "byRuntime": _by(tables["processMemory"], "runtime", _memory)},
        "releases": {
            "distinctCount": one("newestRelease").get("distinct_count", 0),
            "byVersion": _by(tables["releases"], "release", lambda r: _named(r, {"n": "count", "first_seen": "firstSeen", "last_seen": "lastSeen"})),
            "newestSeen": one("newestRelease").get("newest"),
        },
        "typeReach": _by(tables["typeReach"], "type", lambda r: _named(r, {"introduced": "introducedInSchemaVersion", "eligible": "eligibleEvents", "emitted": "emitted", "verdict": "verdict"})),
        "timeline": grid(tables["timeline"]),
        "stallsTimeline": stall_grid(tables["stallsTimeline"], now_ms),
    }


def _counted(pairs: Rows | None) -> dict:
    return {p["key"]: p["n"] for p in pairs or []}


def _last_prune(r: dict | None) -> dict | None:
    return r and _named(r, {"before": "before", "after": "after", "pruned": "pruned", "rewrote": "rewrote", "at_ms": "ts"})


def tallies(blocks: dict[str, dict]) -> dict:
    """The members of the summary that come from the receiver's own tallies."""
    live, rejected, lost, kept, repeats, keys = (blocks[k] for k in ("liveness", "rejections", "persist_errors", "retention", "deduped", "seen_keys"))
    return {
        "liveness": _named(live, {"last_accepted_at": "lastAcceptedAt", "age_ms": "ageSinceLastAcceptedMs", "accepted_since_boot": "acceptedSinceBoot", "last_rejection_at": "lastRejectionAt", "rejection_age_ms": "ageSinceLastRejectionMs", "mismatched_versions": "mismatchedDeclaredVersions"}),
        "rejections": {"total": rejected["total"], "byStatus": _counted(rejected.get("by_status")), "byDeclaredVersion": _counted(rejected.get("by_declared_version"))} | _named(rejected, {"last_status": "lastStatus", "last_reason": "lastReason", "last_seen": "lastSeen"}) | {"timeline": grid(rejected.get("timeline") or [])},
        "persistErrors": _named(lost, {"total": "total", "last_reason": "lastReason", "last_seen": "lastSeen"}) | {"timeline": grid(lost.get("timeline") or [])},
        "retention": {
            "configured": _named(kept["configured"], {"max_rows": "maxEvents", "max_age_ms": "maxAgeMs"}),
            "retainedCount": kept["retained"],
            "totalPruned": kept["total_pruned"],
            "last": _last_prune(kept.get("last")),
            "timeline": grid(kept.get("timeline") or []),
        },
        "deduped": _named(repeats, {"total": "total", "last_seen": "lastSeen"}) | {"timeline": grid(repeats.get("timeline") or [])},
        "seenKeys": {"configured": _named(keys["configured"], {"max_keys": "maxKeys", "ttl_ms": "ttlMs"}), "size": keys["size"]},
    }


def encoded(body: dict) -> str:
    """The body as JSON; whole numbers are written without a fraction, as they were sent."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return _number(x)

    return json.dumps(plain(body), ensure_ascii=False)
