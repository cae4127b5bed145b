"""The telemetry engine over literal events: validity, admission, the log, the summary, retention, the stream."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pulsefold.functions import keys, numbers, validation
from pulsefold.functions import variant as V
from pulsefold.operators import grid, histogram, repeats, retention
from pulsefold.plans import ingest, summary, tallies
from pulsefold.sources import ndjson
from pulsefold.sources.store import Store
from pulsefold.streaming.receiver import Receiver, request_stream

W = {"windowStartedAt": 1, "windowEndedAt": 7}


def event(type_, runtime="main", **fields):
    return {"schemaVersion": 11, "type": type_, "runtime": runtime, "timestamp": 5, **fields}


OPERATION = {"operation": "load-key", "count": 3, "okCount": 2, "failCount": 1, "min": 1, "avg": 2.5, "max": 9, "buckets": [1, 2, 0]}
VALID = {
    "error": event("error", name="Error", message="m", frames=[]),
    "crash": event("crash", "renderer", reason="oom", exitCode=133),
    "stall": event("performance-stall", lagMs=750, source="event-loop"),
    "operations": event("operational-metrics", **W, boundaries=[25, 50], rejected=4, operations=[OPERATION]),
    "server-stall": event("server-stall", "server", **W, count=2, totalMs=7400, maxMs=6000, boundaries=[1000, 2000], buckets=[0, 1, 1], culprits=[{"culprit": "gc", "count": 1, "totalOverlapMs": 2.5}]),
    "names": event("workspace-names", "server", **W, chats=["demo", "demo"], chatCount=2, truncated=False),
    "shape": event("workspace-shape", "renderer", **W, workspaces=2, panesOpen=5, panesActive=3, chats=7, peakPanesOpen=6, peakChats=9),
    "features": event("feature-usage", "renderer", **W, features=[{"name": "global-search", "count": 3}, {"name": "settings", "count": 1}]),
    "memory": event("process-memory", **W, samples=10, rssMinBytes=200, rssAvgBytes=210, rssMaxBytes=230, heapUsedMaxBytes=90, processAgeMs=3600),
}


def but(name, **changes):
    out = {**VALID[name], **changes}
    return {k: v for k, v in out.items() if v is not ...}


INVALID = [
    None, 5, "x", [], {},
    but("error", runtime="cloud"), but("error", timestamp="5"), but("error", schemaVersion=10), but("error", chatName=5), but("error", appVersion=None), but("error", frames={}), but("error", message=...), but("error", type="unknown"),
    but("crash", reason=5), but("stall", lagMs="9"), but("stall", source="other"),
    but("operations", rejected=-1), but("operations", rejectedStale=1.5), but("operations", rejectedStale=None), but("operations", boundaries=[50, 25]), but("operations", boundaries=[]), but("operations", boundaries=[0, 5]),
    but("operations", operations=[{**OPERATION, "buckets": [1, 2]}]), but("operations", operations=[{**OPERATION, "operation": "Bad"}]), but("operations", operations=[{**OPERATION, "operation": "a\n"}]), but("operations", operations=[{**OPERATION, "count": 1.5}]), but("operations", operations=[OPERATION] * 130), but("operations", operations=[5]),
    but("server-stall", runtime="main"), but("server-stall", buckets=[0, 1]), but("server-stall", culprits=[{"culprit": "gc", "count": -1, "totalOverlapMs": 0}]),
    but("names", runtime="main"), but("names", chatCount=1), but("names", chats=["a", 5]), but("names", truncated="no"),
    but("shape", chats=-1), but("shape", chats=1.5), but("shape", chats="7"), but("shape", chats=...), but("shape", extra=1), but("shape", peakChats=6), but("shape", chatName="x"),
    but("features", features=[]), but("features", features=[{"name": "a", "count": 0}]), but("features", features=[{"name": "a", "count": 1}] * 2), but("features", features=[{"name": f"f{i}", "count": 1} for i in range(65)]), but("features", features=[{"name": "a", "count": 1, "x": 1}]), but("features", x=1),
    but("memory", x=1), but("memory", samples=0), but("memory", rssMinBytes=220), but("memory", rssAvgBytes=231), but("memory", heapUsedMaxBytes=None), but("memory", rssMinBytes=1.5),
]
LOOSE = [but("stall", lagMs=1e308), but("crash", reason="", exitCode="any"), but("error", frames=[5, None]), but("memory", heapUsedMaxBytes=...), but("operations", operations=[]), but("operations", rejected=2.0), but("error", chatName="c", extra=5)]


def test_validity(spark):
    cases = [(json.dumps(e), True) for e in [*VALID.values(), *LOOSE]] + [(json.dumps(e), False) for e in INVALID]
    cases.append((json.dumps(VALID["stall"]).replace("750", "1e999"), True))
    df = spark.createDataFrame(cases, "value string, want boolean").withColumn("v", V.parse_strict(F.col("value")))
    wrong = df.withColumn("got", validation.is_valid(F.col("v"))).filter("got IS DISTINCT FROM want").select("value", "got").collect()
    assert wrong == []


def test_strict_lines(spark, tmp_path):
    lines = ['{"a":1}', "", "   ", '{"a":1} junk', '{"torn', "42", "null", '"x"', "'q'", "NaN", "01", "[1]", ' {"b":2} ']
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    log = ndjson.parsed(ndjson.read_lines(spark, str(tmp_path / "log")))
    assert [r["value"] for r in log.filter("event IS NOT NULL").orderBy("seq").collect()] == ['{"a":1}', "42", "null", '"x"', "[1]", '{"b":2}']
    assert ndjson.unreadable(log).first() == (6, 5)
    assert ndjson.typed(log).count() == 3
    assert ndjson.read_lines(spark, str(tmp_path / "none")).count() == 0
    ndjson.write_lines(log, str(tmp_path / "again"))
    assert ndjson.unreadable(ndjson.parsed(ndjson.read_lines(spark, str(tmp_path / "again")))).first() == (6, 0)


def typed(spark, events):
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(events)], "seq long, value string")
    return ndjson.typed(ndjson.parsed(df, F.col("seq")))


@pytest.mark.parametrize(
    ("fields", "want"),
    [
        ({"frames": [{"file": "a.ts", "line": 7, "function": "f"}]}, "E @ a.ts:7 (f)"),
        ({"frames": [{"file": "a.ts"}]}, "E @ a.ts"),
        ({"frames": [{"line": 5}]}, "E @ :5"),
        ({"frames": [{"function": "f"}]}, "E @ (f)"),
        ({"frames": [{"file": "", "function": "", "line": "x"}]}, "E"),
        ({"frames": []}, "E"),
        ({"frames": [{}, {"file": "b"}]}, "E"),
        ({"name": ""}, None),
    ],
)
def test_error_signatures(spark, fields, want):
    assert typed(spark, [event("error", **{"name": "E", "message": "m", **fields})]).first()["signature"] == want


def test_instants_and_filters(spark):
    events = [
        event("crash", reason="a", timestamp=10),
        event("crash", reason="b", timestamp=10, receivedAt=99),
        event("crash", reason="c", timestamp=10, receivedAt=None),
        event("crash", reason="d", timestamp=10, receivedAt="x"),
        event("crash", reason="", exitCode=1),
        event("performance-stall", source="event-loop", lagMs=1, platform="linux", appVersion="1.2"),
    ]
    t = typed(spark, events)
    assert [r["instant"] for r in t.orderBy("seq").collect()] == [10, 99, 10, None, 5, 5]
    assert [r["signature"] for r in t.orderBy("seq").collect()] == ["crash:a", "crash:b", "crash:c", "crash:d", None, "stall:event-loop"]
    count = lambda **f: ndjson.filtered(t, **f).count()
    assert count() == 6 and count(type="") == 6 and count(type="crash") == 5
    assert count(since=10) == 3 and count(since=math.nan) == 6 and count(platform="linux", app_version="1.2") == 1 and count(signature="crash:b") == 1


def test_parameters():
    n = numbers.parameter_number
    assert [n(x) for x in ("", " ", "5", " 5 ", "1e3", "0x10", "-2", ".5", "5.")] == [0, 0, 5, 5, 1000, 16, -2, 0.5, 5]
    assert all(math.isnan(n(x)) for x in (None, "abc", "1_000", "0x", "5px", "nan", "inf"))
    assert n("Infinity") == math.inf
    assert [numbers.retention_setting(x, 7) for x in (None, "", "  ", "x", "-1", "0", " 5 ", "Infinity")] == [7, 7, 7, 7, 7, 0, 5, 7]
    assert [retention.page_limit(x) for x in (None, math.nan, 0, 0.5, 1.9, 150, 999)] == [100, 100, 100, 100, 1, 150, 200]
    assert [retention.page_offset(x, 10) for x in (None, -1, 3.7, 99, math.inf)] == [0, 0, 3, 10, 0]


def test_release_order(spark):
    labels = ["0.1.9", "0.1.10", "1.010", "1.10", "1.0", "1.0.0", "1", "nightly", "1.", "2.0.1", "10.0", "v3"]
    df = spark.createDataFrame([(x,) for x in labels], "v string").withColumn("o", keys.release_order(F.col("v")))
    ranked = {r["v"]: r["r"] for r in df.filter("o IS NOT NULL").selectExpr("v", "dense_rank() OVER (ORDER BY o) r").collect()}
    assert ranked == {"0.1.9": 1, "0.1.10": 2, "1.0": 3, "1.0.0": 3, "1": 3, "1.010": 4, "1.10": 4, "2.0.1": 5, "10.0": 6}


# kernels


def test_histogram_loses_nothing_and_keeps_first_seen(spark):
    rows = [(i, f"k{i % 13}" if i < 40 else "k12") for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "seq long, key string").repartition(7)
    got = {r["key"]: r["n"] for r in histogram.bounded_histogram(df, "key", ["seq"], 10).collect()}
    assert sum(got.values()) == 60 and set(got) == {*(f"k{i}" for i in range(10)), histogram.OVERFLOW}


def test_percentiles_are_nearest_rank(spark):
    def of(counts, bounds):
        df = spark.createDataFrame([("x", i, c, b) for i, (c, b) in enumerate(zip(counts, [*bounds, None], strict=True))], "op string, i int, n long, b int")
        return tuple(histogram.bucket_percentiles(df, ["op"], "i", "n", "b").first()[1:])

    bounds = [50, 100, 250, 500, 1000, 2500, 5000, 10000]
    assert of([1696, 4, 36, 8, 2, 38, 49, 340, 0], bounds) == (50, 10000, 10000)
    assert of([95, 0, 0, 5, 0, 0, 0, 0, 0], bounds) == (50, 50, 500)
    assert of([0, 0, 0, 0, 0, 0, 0, 0, 3], bounds) == (None, None, None)
    assert of([0] * 9, bounds) == (None, None, None)


def test_grids(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 5.0, 50.0, 95.0, 100.0, 101.0, None, math.nan)], "t double")
    got = {r["bucket"]: (r["bucket_start"], r["n"]) for r in grid.now_grid(df, "t", F.lit(100), 100, 10).groupBy("bucket", "bucket_start").agg(F.count("*").alias("n")).collect()}
    assert got == {0: (0, 2), 5: (50, 1), 9: (90, 2)}
    assert grid.now_grid(df, "t", F.lit(100), 0, 10).count() == 0 and grid.now_grid(df, "t", F.lit(100), 100, 0).count() == 0
    slots = {r["bucket"]: r["n"] for r in grid.epoch_slots(df.filter("t IS NOT NULL"), "t", F.lit(105), None, 100, 10).collect()}
    # slots begin at multiples of 10; the window begins at 5, so those of 0 and before are out
    assert slots == {4: 1, 8: 1, 9: 2}


def test_idempotency_is_a_fold(spark):
    times = {"a": [0, 5, 9, 10, 12, 19, 20, 31], "b": [3, 100], "": [1, 2], None: [1, 1]}
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in times.items() for t in ts)]
    got = {r["seq"]: r["accepted"] for r in repeats.accepted_arrivals(spark.createDataFrame(rows, "seq long, key string, t long"), "key", "t", "seq", 10).collect()}
    until = {}
    for seq, k, t in rows:
        ok = not k or t >= until.get(k, -1)
        if ok and k:
            until[k] = t + 10
        assert got[seq] == ok


def test_a_long_run_of_one_key_is_folded_as_a_stream(spark):
    """Gaps below the memory all along, over many batches of rows, and an arrival without an instant."""
    rows = [(i, "hot", 3 * i) for i in range(30_000)] + [(30_000 + i, f"k{i}", i) for i in range(200)] + [(99_999, "hot", None)]
    got = {r["seq"]: r["accepted"] for r in repeats.accepted_arrivals(spark.createDataFrame(rows, "seq long, key string, t long").repartition(5), "key", "t", "seq", 10).collect()}
    assert len(got) == len(rows) and not got[99_999] and all(got[30_000 + i] for i in range(200))
    assert [i for i in range(30_000) if got[i]] == list(range(0, 30_000, 4))


def test_retention_and_pages(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i * 10)) for i in range(20)], "seq long, t double")
    at = lambda d: sorted(r["seq"] for r in d.collect())
    assert at(retention.retained(df, "seq", "t", F.lit(200), 0, 50)) == [0, 5, 10, 15, 16, 17, 18, 19]
    assert at(retention.retained(df, "seq", "t", F.lit(200), 5, 50)) == [15, 16, 17, 18, 19]
    assert at(retention.retained(df, "seq", "t", F.lit(200))) == list(range(20))
    assert [r["seq"] for r in retention.newest(df, "seq", 3, 2).collect()] == [15, 16, 17]
    assert retention.newest(df, "seq", 3, 20).count() == 0


# admission


def request(seq, events, key=None, at=1000, version="11", **more):
    headers = {"X-Telemetry-Schema": version, **({"Idempotency-Key": key} if key is not None else {}), **more.pop("headers", {})}
    body = more.pop("body", json.dumps({"schemaVersion": 1, "events": events}).encode())
    return {"seq": seq, "arrived_at_ms": at, "method": "POST", "target": "/ingest?x=1", "headers": {k: v for k, v in headers.items() if v is not None}, "body": body, **more}


def test_gates(spark):
    good = [VALID["crash"], VALID["memory"]]
    old = [{**e, "schemaVersion": 9} for e in good]
    cases = [
        (request(0, good), 202), (request(1, []), 202), (request(2, old, version="9"), 202),
        (request(3, old), 422), (request(4, good, version="10"), 422), (request(5, [*good, {}]), 422), (request(6, good, version="8"), 415), (request(7, good, version="011"), 415), (request(8, good, version=None), 415),
        (request(9, good, method="GET"), 404), (request(10, good, target="/other"), 404), (request(11, good, body=b"{"), 400), (request(12, good, body=b'{"events":5}'), 400), (request(13, good, body=b"[]"), 400), (request(14, None), 400),
        (request(15, good, headers={"Content-Length": "2000000"}), 413), (request(16, good, body=b" " * 1100000), 413), (request(17, [event("error", name="é" * 10, message="", frames=[])]), 202),
    ]
    df = spark.createDataFrame([c for c, _ in cases], ingest.REQUEST)
    assert {r["seq"]: r["status"] for r in ingest.judged(df).collect()} == {c["seq"]: s for c, s in cases}
    guarded = ingest.judged(df.withColumn("headers", F.map_concat("headers", F.create_map(F.lit("AUTHORIZATION"), F.when(F.col("seq") == 0, "bearer  t0k ").otherwise("Bearer no")))), ingest.Settings(token="t0k"))
    assert {r["seq"] for r in guarded.filter("status = 202").collect()} == {0} and guarded.filter("seq = 1").first()["status"] == 401


def test_admission_and_log(spark):
    e = VALID["crash"]
    rows = [request(0, [e, {**e, "receivedAt": 5}], "k", 1000), request(1, [e], "k", 2000), request(2, [{}], "z", 2500), request(3, [e], "z", 2600), request(4, [e], "k", 700_000), request(5, [e], "", 700_001), request(6, [e], "", 700_002), request(7, [e], "s", 3000)]
    seen = spark.createDataFrame([("s", 3001), ("q", 10**9)], "key string, expires_at long")
    out = ingest.admitted(spark.createDataFrame(rows, ingest.REQUEST), seen)
    got = {r["seq"]: (r["status"], r["deduped"], r["accepted"]) for r in out.collect()}
    assert got == {0: (202, False, 2), 1: (202, True, 0), 2: (422, False, 0), 3: (202, False, 1), 4: (202, False, 1), 5: (202, False, 1), 6: (202, False, 1), 7: (202, True, 0)}
    log = ingest.log_rows(out).orderBy("request", "position").collect()
    assert [json.loads(r["value"]) for r in log[:2]] == [{**e, "receivedAt": 1000}] * 2 and len(log) == 6
    assert {(r["key"], r["expires_at"]) for r in ingest.live_entries(out).collect()} == {("k", 601_000), ("z", 602_600), ("k", 1_300_000)}
    totals = {r["tally"]: r["total"] for r in tallies.totals(out).collect()}
    assert totals == {"rejections": 1, "persist_errors": 0, "deduped": 2}


def test_targets_that_name_nothing(spark):
    targets = {"//": 400, "///x": 404, "//?a": 400, "//:80/ingest": 400, "//a b/ingest": 400, "//[x/ingest": 400, None: 400, "": 404, "//host/ingest": 202, "//[::1]:8/ingest": 202, "http://h/ingest?x": 202, "/ingest#f": 202, "/ingest/": 404, "/a//b": 404}
    df = spark.createDataFrame([request(i, [], target=t) for i, t in enumerate(targets)], ingest.REQUEST)
    rows = {r["seq"]: r for r in ingest.judged(df).collect()}
    assert [rows[i]["status"] for i in range(len(targets))] == list(targets.values())
    assert rows[0]["reason"] == ingest.NO_TARGET and rows[8]["reason"] is None


def test_numbered_appends_count_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda a, b: spark.createDataFrame([(i, float(i), "{}") for i in range(a, b)], "seq long, instant double, value string")
    for number in (0, 0, 1, 1):
        store.append(rows(10 * number, 10 * number + 10), number)
    store.append(rows(20, 22))
    assert store.read().count() == 22
    assert store.prune(0, 15)["after"] == 15
    store.append(rows(10, 20), 1)  # a version has taken it in
    store.append(rows(30, 31), 2)
    assert sorted(r["seq"] for r in store.read().collect()) == [*range(7, 22), 30]


class Stop(Exception):
    pass


def test_a_batch_that_broke_off_anywhere_is_made_good(spark, tmp_path, monkeypatch):
    """Whatever step a run ends at, no row of it shows, no file of it stays, and the next run of the batch stores all of it once."""
    from pulsefold.streaming import receiver as module

    e = VALID["crash"]
    batch = spark.createDataFrame([request(0, [e, e], "a", 1000), request(1, [e], "a", 1500), request(2, [e], "b", 2000)], ingest.REQUEST)
    stop = lambda *a, **k: (_ for _ in ()).throw(Stop())

    def after(kind, write):
        return lambda table, k: stop() if k == kind else write(table, k)

    def unnamed(r, what):
        return [n for n in r.store.files.listed(what) if n.startswith("part=")]

    for step in ("admitted", "log_rows", "live_entries", "live_keys", "outcomes", "keys", "commit", "create"):
        r = Receiver(spark, str(tmp_path / step))
        with monkeypatch.context() as m:
            if step in ("outcomes", "keys"):
                m.setattr(r.store, "write", after(step, r.store.write))
            elif step == "commit":
                m.setattr(r.store, step, stop)
            elif step == "create":
                m.setattr(r.store.files, step, stop)
            else:
                m.setattr(module, step, stop)
            with pytest.raises(Stop):
                r.batch(batch, 0)
        assert r.store.read().count() == r.outcomes().count() == 0
        assert not any(unnamed(r, kind) for kind in ("events", "rollups", "outcomes", "keys")), step
        again = Receiver(spark, str(tmp_path / step))
        again.batch(batch, 0)
        again.batch(batch, 0)
        assert again.store.read().count() == 3 and again.outcomes().count() == 3
        assert {x["key"] for x in again.live(0).collect()} == {"a", "b"}
        with pytest.raises(ValueError, match="keys of batch 1"):
            again.batch(batch, 2)


def test_events_that_cannot_be_stored(spark, tmp_path, monkeypatch):
    r = Receiver(spark, str(tmp_path / "r"))
    e = VALID["crash"]
    batch = spark.createDataFrame([request(0, [e], "a", 1000), request(1, [{}], "b", 1001)], ingest.REQUEST)
    monkeypatch.setattr(r.store, "part", lambda *a: (_ for _ in ()).throw(OSError()))
    r.batch(batch, 0)
    assert r.store.read().count() == 0
    assert {x["seq"]: x["status"] for x in r.outcomes().collect()} == {0: 503, 1: 422}
    assert r.live(0).count() == 0
    tally = tallies.persist_tally(r.outcomes(), F.lit(5000)).first()
    assert (tally["total"], tally["last_reason"], tally["last_seen"]) == (1, ingest.REASONS[503], 1000) and tally["timeline"][-1]["n"] == 1


def test_retention_runs_with_the_receiver(spark, tmp_path):
    r = Receiver(spark, str(tmp_path / "r"), max_rows=5, max_age_ms=1_000_000, sweep_ms=50_000)
    e = VALID["crash"]
    sizes = []
    for i, (n, at) in enumerate([(3, 1000), (3, 2000), (1, 3000), (1, 60_000)]):
        r.batch(spark.createDataFrame([request(10 * i + k, [e], None, at) for k in range(n)], ingest.REQUEST), i)
        sizes.append(r.store.read().count())
    assert sizes == [3, 5, 6, 5]  # the bound is crossed, then not, then a sweep is due
    tally = tallies.retention_tally(r.prunes(), F.lit(60_001), 5, 1_000_000).first()
    assert tally["total_pruned"] == 3 and tally["retained"] == 5 and tally["last"]["before"] == 7 and tuple(tally["configured"]) == (5, 1_000_000)
    assert sum(x["n"] for x in tally["timeline"]) == 3
    assert tallies.since_start(r.prunes(), 50_000, "at_ms").count() == 1


def test_read_routes(spark):
    from pulsefold.plans import routes

    assert routes.parameters(spark, "/events?type=a&type=b&since=&x=%20y") == ("/events", {"type": "a", "since": "", "x": " y"})
    lines = [json.dumps(event("crash", reason="oom", timestamp=i, platform="linux" if i % 2 else "mac")) for i in range(10)] + ["torn{", "7"]
    log = ndjson.parsed(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"), F.col("seq"))
    outcomes = spark.createDataFrame([(1, 50, "8", None, 415, "old", False, 0), (2, 60, "11", "k", 202, None, True, 0), (3, 5, "7", None, 415, "before", False, 0)], tallies.OUTCOME)
    state = routes.State(started_at=8, version="v1", outcomes=outcomes)
    ask = lambda target, method="GET": tuple(routes.answer(spark, log, target, state, 100, method).first())
    status, body = ask("/summary?platform=linux")
    whole = json.loads(body)
    assert status == 200 and (whole["total"], whole["matched"], whole["unreadable"], whole["firstSeen"], whole["lastSeen"]) == (11, 5, 1, 1, 9)
    assert (whole["startedAt"], whole["readAt"], whole["receiverVersion"]) == (8, 100, "v1")
    live = whole["liveness"]
    assert live == {"lastAcceptedAt": 9, "ageSinceLastAcceptedMs": 91, "acceptedSinceBoot": True, "lastRejectionAt": 50, "ageSinceLastRejectionMs": 50, "mismatchedDeclaredVersions": ["8"]}
    assert whole["rejections"]["total"] == 1 and whole["rejections"]["lastReason"] == "old" and whole["rejections"]["byDeclaredVersion"] == {"8": 1} and whole["deduped"]["total"] == 1 and whole["persistErrors"]["lastSeen"] is None
    assert whole["seenKeys"] == {"configured": {"maxKeys": 0, "ttlMs": 0}, "size": 0} and whole["retention"]["last"] is None
    assert whole["byType"]["crash"] == 5 and whole["platforms"] == {"linux": 5} and whole["topSignatures"] == [{"signature": "crash:oom", "type": "crash", "count": 5}]
    assert whole["workspaceShape"]["counts"]["chats"] == {"windowsSeen": 0, "min": None, "avg": 0, "max": None} and whole["timeline"]["bucketMs"] == 1_800_000
    status, body = ask("/events?limit=2&offset=1&platform=mac")
    page = json.loads(body)
    assert status == 200 and [x["timestamp"] for x in page["events"]] == [4, 6] and (page["limit"], page["offset"], page["matched"]) == (2, 1, 5)
    assert json.loads(ask("/capabilities")[1]) == {"schemaVersion": 11, "acceptedSchemaVersions": [9, 10, 11], "authRequired": False}
    assert ask("/other")[0] == ask("/summary", "POST")[0] == 404 and ask("//[x")[0] == 400


def test_store_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.prune(0, 5)["rewrote"] is False
    rows = lambda a, b: spark.createDataFrame([(i, float(i), "{}") for i in range(a, b)], "seq long, instant double, value string")
    store.append(rows(0, 10))
    before = store.read()
    store.append(rows(10, 20))
    assert store.read().count() == 20
    assert store.prune(20, 8) == {"before": 20, "after": 8, "pruned": 12, "rewrote": True}
    assert sorted(r["seq"] for r in store.read().collect()) == list(range(12, 20))
    assert store.prune(20, 8) == {"before": 8, "after": 8, "pruned": 0, "rewrote": False}
    assert before.count() in (10, 20)  # a reader of the old snapshot is not disturbed


def test_stream_admits_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    e = VALID["crash"]
    receiver = Receiver(spark, str(tmp_path / "receiver"))
    for i, part in enumerate(([request(0, [e, e], "a", 1000), request(1, [{}], None, 1001)], [request(2, [e], "a", 2000), request(3, [e], "b", 2001)])):
        spark.createDataFrame(part, ingest.REQUEST).coalesce(1).write.mode("append").parquet(str(inbox))
        receiver.start(request_stream(spark, str(inbox)), available_now=True).awaitTermination()
        assert receiver.outcomes().count() == 2 * (i + 1)
    assert {r["seq"]: (r["status"], r["deduped"]) for r in receiver.outcomes().collect()} == {0: (202, False), 1: (422, False), 2: (202, True), 3: (202, False)}
    assert receiver.store.read().count() == 3
    receiver.batch(spark.createDataFrame([request(9, [e], "c", 1)], ingest.REQUEST), 1)  # run again: nothing more
    assert receiver.store.read().count() == 3


# summary


def test_summary_of_windows(spark):
    op = lambda **x: {**OPERATION, **x}
    m = lambda *ops, **x: event("operational-metrics", x.pop("runtime", "main"), **W, boundaries=x.pop("boundaries", [25, 50]), operations=list(ops), **{"rejected": 0, **x})
    t = typed(spark, [
        m(op(count=10, avg=100, min=5, max=200), rejected=4),
        m(op(count=1, avg=1000, min=900, max=1000), op(operation="idle", count=0, min=0, avg=0, max=0, buckets=[0, 0, 0]), rejected="x", rejectedStale=2),
        m(op(count=2, avg=1, buckets=[7, 0]), boundaries=[99]),
        m(op(operation="bad", count=-1), 5, op(operation=""), runtime="server", rejected="x"),
    ])
    ops = {r["name"]: r for r in summary.operations(t).collect()}
    assert set(ops) == {"load-key", "idle"} and ops["load-key"]["n"] == 13
    assert ops["load-key"]["mean"] == pytest.approx(2002 / 13) and ops["load-key"]["low"] == 1 and ops["load-key"]["high"] == 1000
    assert (ops["idle"]["low"], ops["idle"]["mean"]) == (None, 0)
    latency = {r["name"]: r for r in summary.operation_latency(t).collect()}
    assert latency["load-key"]["boundaries"] == [99] and latency["load-key"]["excluded"] == 6 and latency["load-key"]["p50"] == 99
    assert latency["idle"]["boundaries"] is None and latency["idle"]["p50"] is None
    rejected = {r["runtime"]: tuple(r)[1:6] for r in summary.operation_rejections(t).collect()}
    assert rejected == {"main": (3, 1, 4, 2, None), "server": (1, 0, None, None, None), "renderer": (0, 0, None, None, None)}


def test_summary_of_stalls_memory_and_names(spark):
    stall = lambda lag, **x: event("performance-stall", lagMs=lag, **({"source": "event-loop"} | x))
    memory = lambda **x: {**VALID["memory"], **x}
    t = typed(spark, [
        stall(50), stall(200), stall("bad"), event("performance-stall", lagMs=5000), stall(None, source=""),
        memory(samples=1, rssAvgBytes=100, rssMaxBytes=300), memory(samples=2, rssAvgBytes=101, rssMaxBytes=300, windowEndedAt=9), memory(runtime="bogus"),
        but("names", chats=["a", "a", "b", "", 5], chatCount=9, windowEndedAt=3, truncated="yes"), but("names", chats=["a", "chat-abc123"], chatCount=4, windowEndedAt="x"), but("names", chats=["shell-x1"], chatCount=1, windowEndedAt=2, truncated=True),
        event("crash", reason="x", appVersion="0.1.9"), event("crash", reason="y", appVersion="0.1.10"), event("crash", reason="x", appVersion="nightly"),
    ])
    assert tuple(summary.stalls(t).first()) == (5, 50, 5000, 1750)
    (source,) = [tuple(r) for r in summary.stalls_by_source(t).collect() if r["source"] == "event-loop"]
    assert source == ("event-loop", 3, 50, 200, 125)
    rows = {r["runtime"]: r for r in summary.process_memory(t).collect()}
    assert set(rows) == {"main", "renderer", "server"} and rows["server"]["samples"] is None
    assert rows["main"]["mean"] == 101 and rows["main"]["peak"]["ended"] == 9 and rows["main"]["latest"]["ended"] == 9
    names = summary.workspace_names(t)
    assert {r["name"]: r["windows"] for r in names.collect()} == {"a": 2, "b": 1, "chat-abc123": 1, "shell-x1": 1}
    assert tuple(summary.generated_share(names).first()) == (4, 1, 0.25)
    assert tuple(summary.workspace_latest(t).first()) == (9, 9, True, 3)
    assert tuple(summary.newest_release(t).first()) == ("0.1.10", 3)
    assert {r["reason"]: r["n"] for r in summary.crash_reasons(t).collect()} == {"x": 2, "y": 1}
    reach = {r["type"]: (r["eligible"], r["verdict"]) for r in summary.type_reach(t).collect()}
    assert reach["crash"] == (14, "emitting") and reach["error"] == (14, "eligible-silent")


def test_summary_document_has_no_messages(spark):
    t = typed(spark, [{**VALID["error"], "message": "private", "chatName": "hidden", "sessionName": "hidden"}, *VALID.values()])
    rows = {r["axis"]: r["rows"] for r in summary.document(t, 10).collect()}
    assert set(rows) == {*summary.AXES, "timeline", "stallsTimeline"}
    assert not any("private" in x or "hidden" in x for x in rows.values())
    assert len(json.loads(rows["byType"])) == 9
    assert json.loads(rows["featureUsage"]) == [{"name": "global-search", "uses": 3.0, "windows": 1}, {"name": "settings", "uses": 1.0, "windows": 1}]


def test_pages(spark):
    from pulsefold.plans import pages

    lines = [json.dumps(event("crash", reason=f"r{i % 3}", timestamp=i)) for i in range(250)] + ["7", "torn{"]
    log = ndjson.parsed(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"), F.col("seq"))
    first = pages.page(log).first()
    assert (first["total"], first["matched"], first["limit"], first["offset"]) == (251, 250, 100, 0)
    assert [json.loads(x)["timestamp"] for x in first["events"]] == list(range(150, 250))
    some = pages.page(log, limit="1000", offset="70", since="10", signature="crash:r1").first()
    assert (some["matched"], some["limit"], some["offset"]) == (80, 200, 70)
    assert [json.loads(x)["timestamp"] for x in some["events"]] == list(range(10, 40, 3))
    assert pages.page(log, offset="999", since="").first()["events"] == []
    assert tuple(pages.capabilities(spark, True).first()) == (11, [9, 10, 11], True)


# the store's versions


def appended(store, spark, parts, per=10, kind="crash"):
    """`parts` parts of `per` events; event i has the stamp 1000 i."""
    for i in range(parts):
        rows = [(k, json.dumps({**event(kind, reason=f"r{k % 3}", platform="linux" if k % 2 else "mac", appVersion=f"1.{k % 4}"), "receivedAt": 1000 * k})) for k in range(i * per, (i + 1) * per)]
        store.append(spark.createDataFrame(rows, "seq long, value string"))


def test_filters_reach_the_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    day = 86_400_000
    for d in range(3):
        rows = [(10 * d + k, json.dumps({**event("crash" if k % 2 else "error", reason=f"r{k}", name="E", message="", frames=[]), "receivedAt": d * day + k})) for k in range(10)]
        store.append(spark.createDataFrame(rows, "seq long, value string"))
    at = store.snapshot()
    some = at.events(since=2 * day + 3, type="crash", signature="crash:r5")
    assert [r["seq"] for r in some.collect()] == [25]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = at.events(since=2 * day + 3, type="crash", signature="crash:r5")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(type,crash)" in plan and "EqualTo(signature,crash:r5)" in plan and "GreaterThanOrEqual(instant" in plan
    assert "PartitionFilters: [isnotnull(day" in plan and len(some.inputFiles()) < len(at.events().inputFiles())
    assert all(at.parts[2]["path"] in f for f in some.inputFiles())
    # the same rows as the text gives
    lines = at.events().select("seq", F.to_json("event").alias("value"))
    text = ndjson.typed(ndjson.parsed(lines, F.col("seq")))
    same = [c for c in text.columns if c != "event"]
    assert sorted(map(repr, text.select(same).collect())) == sorted(map(repr, at.events().select(same).collect()))


def test_rollups_of_parts_give_every_label_axis(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    kinds = [*VALID.values()] * 3
    rows = [(i, json.dumps({**e, "appVersion": f"0.{i % 5}.{i % 3}", "platform": ["mac", "linux", "win"][i % 3], "receivedAt": 50 * i + 7, **({"lagMs": i} if e["type"] == "performance-stall" else {})})) for i, e in enumerate(kinds)]
    for part in (rows[:7], rows[7:19], rows[19:]):
        store.append(spark.createDataFrame(part, "seq long, value string"))
    at = store.snapshot()
    for chosen in ({}, {"platform": "linux"}, {"type": "crash", "app_version": "0.1.1"}):
        whole, merged = summary.axes(at.events(**chosen), 10**6), summary.axes(at.events(**chosen), 10**6, at.rollup(**chosen))
        for name in summary.LABEL_AXES:
            assert sorted(map(repr, merged[name].collect())) == sorted(map(repr, whole[name].collect())), (name, chosen)


def test_label_axes_read_no_event(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    appended(store, spark, 2)
    at = store.snapshot()
    for name, table in summary.axes(at.events(), 10**6, at.rollup()).items():
        read = {f.rpartition("/part=")[0].rpartition("/")[2] for f in table.inputFiles()}
        assert read <= ({"rollups"} if name in summary.LABEL_AXES else {"events"}), name


def test_pages_open_their_parts_alone(spark, tmp_path):
    from pulsefold.plans import pages

    store = Store(spark, str(tmp_path / "s"))
    appended(store, spark, 6)
    at = store.snapshot()
    log = ndjson.parsed(at.events().select("seq", F.to_json("event").alias("value")), F.col("seq"))
    for asked in ({"limit": "7", "offset": "13"}, {"limit": "5", "offset": "55"}, {"offset": "99"}, {"limit": "4", "offset": "9", "platform": "linux"}, {"limit": "9", "since": "21500", "signature": "crash:r1"}, {"since": "1e9"}):
        assert pages.page(at, **asked).first() == pages.page(log, **asked).first(), asked
    matched, skip, rows = pages._sought(at, 7, 13.0, None, {})
    assert (matched, skip) == (60, 13) and all(any(at.parts[i]["path"] in f for i in (4, 3)) for f in rows.inputFiles()) and rows.count() == 7
    # arrivals of two parts overlap: they are one stretch
    store.append(spark.createDataFrame([(k, json.dumps({**event("crash", reason="late"), "receivedAt": 5})) for k in (15, 45)], "seq long, value string"))
    late = store.snapshot()
    both = ndjson.parsed(late.events().select("seq", F.to_json("event").alias("value")), F.col("seq"))
    assert pages.page(late, limit="20", offset="10").first()["matched"] == 62
    key = lambda page: sorted(page.first()["events"])
    assert key(pages.page(late, limit="62")) == key(pages.page(both, limit="62"))


def test_prunes_cut_drop_and_keep_parts(spark, tmp_path):
    r = random.Random(8)
    for i, (rows, age) in enumerate([(0, 31_500), (25, 0), (12, 35_000), (1000, 10**9), (5, 1)]):
        store = Store(spark, str(tmp_path / f"s{i}"))
        appended(store, spark, 5)
        before = {p["path"] for p in store.snapshot().parts}
        want = [k for k in range(50) if not age or 1000 * k >= 49_000 - age]
        want = want[-rows:] if rows else want
        report = store.prune(49_000, rows, age)
        after = store.snapshot()
        assert sorted(x["seq"] for x in after.events().collect()) == want
        assert report == {"before": 50, "after": len(want), "pruned": 50 - len(want), "rewrote": len(want) < 50}
        kept = [p for p in after.parts if p["path"] in before]
        assert len(kept) == sum(all(k in want for k in range(10 * j, 10 * j + 10)) for j in range(5)) and len(after.parts) - len(kept) <= 1
        assert after.manifest["prunes"][-1]["pruned"] == 50 - len(want)
    # arrivals in no order: the edge is found over all parts
    store, seqs = Store(spark, str(tmp_path / "mixed")), list(range(40))
    r.shuffle(seqs)
    for i in range(4):
        store.append(spark.createDataFrame([(s, json.dumps({**event("crash", reason="x"), "receivedAt": s})) for s in seqs[10 * i : 10 * i + 10]], "seq long, value string"))
    store.prune(0, 17)
    assert sorted(x["seq"] for x in store.read().collect()) == list(range(23, 40))


def test_nth_latest(spark):
    from pulsefold.operators.retention import nth_latest

    r = random.Random(9)
    values = [r.choice([r.randint(-50, 50), r.randint(-(1 << 62), 1 << 62)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(3)
    for n in (1, 2, 150, 299, 300, 301):
        assert nth_latest(df, "x", n, buckets=7) == sorted(values, reverse=True)[min(n, 300) - 1]
    assert nth_latest(df.filter("x > 1e30"), "x", 1) is None


def test_writers_side_by_side(spark, tmp_path):
    """A prune that began before an append keeps what the append added; of two prunes at once one gives up."""
    from pulsefold.sources.ledger import Conflict

    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    appended(store, spark, 2)
    take = store._part

    def meanwhile(*a, **k):
        store._part = take
        other.append(spark.createDataFrame([(99, json.dumps({**event("crash", reason="new"), "receivedAt": 1}))], "seq long, value string"))
        return take(*a, **k)

    store._part = meanwhile
    assert store.prune(0, 5)["after"] == 5
    assert sorted(x["seq"] for x in store.read().collect()) == [15, 16, 17, 18, 19, 99] and store.snapshot().manifest["appended"] == 1

    def pruned(*a, **k):
        store._part = take
        other.prune(0, 3)
        return take(*a, **k)

    store._part = pruned
    with pytest.raises(Conflict):
        store.prune(0, 2)
    assert sorted(x["seq"] for x in store.read().collect()) == [18, 19, 99]
    assert {p["path"] for p in store.snapshot().parts} <= {f"events/{n}" for n in store.files.listed("events")}


def test_pruned_events_leave_the_disk(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    appended(store, spark, 3)
    old = store.snapshot()
    store.prune(0, 5)
    now = max(store.ledger.numbers().values()) + 10_000
    assert store.clean(now, 60_000) == 0 and old.events().count() == 30  # a reader may still hold it
    assert store.clean(now, 5_000) == 6  # three parts and their rollups
    assert store.read().count() == 5 and len(store.files.listed("events")) == 1 and len(store.ledger.numbers()) == 1
    files = [f for f in (tmp_path / "s").rglob("*.parquet")]
    assert sum(f.name.endswith(".parquet") for f in files if "events" in f.parts) >= 1
    store.append(spark.createDataFrame([(77, json.dumps(event("crash", reason="more")))], "seq long, value string"))
    assert store.compact(1) and store.read().count() == 6 and len(store.snapshot().parts) == 1 and not store.compact(1)


def test_maintenance_is_due_by_its_own_rules(spark, tmp_path):
    from pulsefold.streaming.maintenance import Maintenance

    store = Store(spark, str(tmp_path / "s"))
    keeper = Maintenance(store, max_rows=4, max_age_ms=0, debounce_ms=60_000)
    rows = lambda a, b: spark.createDataFrame([(i, json.dumps({**event("crash", reason="x"), "receivedAt": i})) for i in range(a, b)], "seq long, value string")
    assert keeper.tick(10**9) is None  # nothing to prune
    store.commit(store.part(rows(0, 3)), 0, now_ms=1000, max_rows=4)
    assert not keeper.due(10**9)  # the bound isn't reached
    store.commit(store.part(rows(3, 6)), 1, now_ms=2000, max_rows=4)
    assert not keeper.due(61_000) and keeper.due(62_000)  # a burst is let pass
    store.commit(store.part(rows(6, 7)), 2, now_ms=61_999, max_rows=4)
    assert not keeper.due(61_999) and keeper.due(62_000)  # later appends don't put it off
    assert keeper.tick(62_000)["after"] == 4 and not keeper.due(10**9)
    store.commit(store.part(rows(7, 12)), 3, now_ms=70_000, max_rows=4)
    assert Maintenance(Store(spark, store.folder), max_rows=4).due(130_000)  # it is armed again, and a restart knows
    aged = Maintenance(store, max_age_ms=1000, sweep_ms=300_000)
    assert not aged.due(361_999) and aged.due(362_000)  # since the last prune


def test_an_idle_receiver_sweeps(spark, tmp_path):
    """Without any request the timer prunes what has grown old, and its files go."""
    import time

    r = Receiver(spark, str(tmp_path / "r"), max_age_ms=1000, sweep_ms=2000)
    now = int(time.time() * 1000)
    r.batch(spark.createDataFrame([request(0, [VALID["crash"]], "a", now)], ingest.REQUEST), 0)
    assert r.store.read().count() == 1
    timer = r.start_maintenance("1 second", grace_ms=0)
    try:
        end = time.time() + 90
        while time.time() < end and (r.store.snapshot().rows or r.store.files.listed("events")):
            time.sleep(1)
    finally:
        timer.stop()
    assert r.store.read().count() == 0 and not r.store.files.listed("events") and r.prunes().count() >= 1
    assert r.outcomes().count() == 1  # the tallies since the start stay
    r.batch(spark.createDataFrame([request(1, [VALID["crash"]], "a", now + 10)], ingest.REQUEST), 1)
    assert r.outcomes().filter("deduped").count() == 1


def test_lines_keep_their_order_over_files_and_tasks(spark, tmp_path):
    r = random.Random(10)
    lines, at = [], 0
    for i in range(4):
        own = [json.dumps({"i": at + k, "pad": "x" * r.randint(0, 3000)}) if r.random() > 0.1 else r.choice(["", "torn{", "  "]) for k in range(300)]
        at += 300
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / f"{i:03d}.ndjson").write_text("\n".join(own) + "\n")
        lines += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    try:
        for size in ("1g", "50k", "7k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            table = ndjson.ordered_lines(spark, str(tmp_path / "log"))
            got.append([tuple(x) for x in table.orderBy("seq").collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] == got[2] == list(enumerate(lines))
    log = ndjson.parsed(ndjson.ordered_lines(spark, str(tmp_path / "log")), F.col("seq"))
    for _ in range(2):
        ndjson.write_lines(log.repartition(5), str(tmp_path / "again"))
    events = [x for x in lines if x.startswith("{\"i")]
    assert [json.loads(x[1])["i"] for x in sorted(ndjson.ordered_lines(spark, str(tmp_path / "again")).collect())] == [json.loads(x)["i"] for x in events] * 2


def test_targets(spark):
    from pulsefold.functions.target import parts

    want = {
        "/ingest": ("/ingest", []), "/a/./b/../c": ("/a/c", []), "/a/%2E%2e/b": ("/b", []), "/..": ("/", []), "/a/b/..": ("/a/", []), "\\ingest\\x": ("/ingest/x", []), "ingest": ("/ingest", []), "": ("/", []), " /ingest\t": ("/ingest", []),
        "/events?type=a%20b+c&x=%zz&=1&y&&z=a=b#f?g=1": ("/events", [("type", "a b c"), ("x", "%zz"), ("", "1"), ("y", ""), ("z", "a=b")]), "?q=%C3%A9%": ("/", [("q", "é%")]),
        "http://h:80/p?x=1": ("/p", [("x", "1")]), "http:/p": ("/p", []), "http:p": ("/p", []), "https:h/p": ("/p", []), "//user:pw@h:9/p": ("/p", []), "//[::1]/p": ("/p", []), "//1.2.3.4/p": ("/p", []), "///h/p": ("/p", []),
        "//": None, "///": None, "//?a": None, "//:80/p": None, "//a b/p": None, "//h:99999/p": None, "//h:x/p": None, "//[x/p": None, "//1.2.3.256/p": None, "//a%20b/p": None, "http://": None, None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "i int, t string").select("i", parts(F.col("t")).alias("p"))
    got = {r["i"]: r["p"] and (r["p"]["path"], [tuple(q) for q in r["p"]["query"]]) for r in df.collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_routes_over_a_store(spark, tmp_path, monkeypatch):
    from pulsefold.plans import routes

    store = Store(spark, str(tmp_path / "s"))
    appended(store, spark, 3)
    (tmp_path / "lines").write_text("torn{\n42\n" + json.dumps({**event("error", name="E", message="", frames=[]), "receivedAt": 7}) + "\n")
    store.load(str(tmp_path / "lines"))
    (tmp_path / "package.json").write_text('{"version":"2.0"}')
    state = routes.State(started_at=8, version=routes.version_of(str(tmp_path / "package.json")))
    at = store.snapshot()
    ask = lambda target, log=at: tuple(routes.answer(spark, log, target, state, 30_000).first())
    body = json.loads(ask("/summary")[1])
    assert (body["total"], body["matched"], body["unreadable"], body["byType"]["crash"], body["byType"]["error"], body["receiverVersion"]) == (32, 31, 1, 30, 1, "2.0")
    text = ndjson.parsed(at.events().select("seq", F.to_json("event").alias("value")), F.col("seq"))
    for target in ("/summary?platform=linux", "/summary?since=15000&type=crash", "/events?limit=3&offset=4&signature=crash%3Ar1"):
        one, two = (json.loads(ask(target, log)[1]) for log in (at, text))
        assert {k: v for k, v in one.items() if k not in ("total", "unreadable")} == {k: v for k, v in two.items() if k not in ("total", "unreadable")}, target
    files = set((tmp_path / "s").rglob("*"))
    held = [p for p in tmp_path.rglob("table-*")]
    ask("/summary", text)
    assert set((tmp_path / "s").rglob("*")) == files and [p for p in tmp_path.rglob("table-*")] == held
    monkeypatch.setattr(routes.summary, "document", lambda *a: (_ for _ in ()).throw(OSError("disk gone")))
    assert ask("/summary")[0] == 500 and json.loads(ask("/summary")[1]) == {"error": "could not read summary: disk gone"}
    assert routes.version_of(str(tmp_path / "none")) is None and ask("/x") == (404, '{"error": "not found"}') and ask("//")[0] == 400


def test_hot_keys_are_folded_in_slices(spark):
    """Keys of many arrivals, judged slice by slice, give what the fold gives, whatever the slices' width is."""
    r = random.Random(12)
    rows = []
    for name, n, span in (("hot", 900, 9000), ("dense", 400, 300), ("sparse", 60, 90_000), ("few", 5, 900)):
        rows += [(name, r.randint(0, span)) for _ in range(n)]
    rows += [("", 5), (None, 5), ("hot", None), ("hot", 0), ("hot", 0)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "seq long, key string, at long").repartition(4)
    until, want = {}, {}
    for i, (k, t) in sorted(enumerate(rows), key=lambda x: (x[1][1] is None, x[1][1], x[0])):
        ok = not k or (t is not None and t >= until.get(k, -1))
        want[i] = ok
        if k and ok:
            until[k] = t + 100
    plain = {x["seq"]: x["accepted"] for x in repeats.accepted_arrivals(df, "key", "at", "seq", 100).collect()}
    assert plain == want
    assert {x["seq"]: x["accepted"] for x in repeats.accepted_arrivals(df, "key", "at", "seq", 100, hot_rows=50).collect()} == want
    some = df.filter("key <> ''").withColumns({"__key": F.col("key"), "__at": F.col("at")})
    for width in (7, 100, 1000):
        out = repeats.spread_arrivals(some, "seq", 100, width)
        assert {x["seq"]: x["accepted"] for x in out.collect()} == {i: ok for i, ok in want.items() if rows[i][0]}


def test_one_hot_key_is_spread_over_tasks(spark):
    """All rows have one key: no task reads more than its share of them."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(40_000).select(F.col("id").alias("seq"), F.lit("k").alias("key"), (F.col("id") * 50).alias("at"))
        some = df.withColumns({"__key": F.col("key"), "__at": F.col("at")})
        out = repeats.spread_arrivals(some, "seq", 10_000, 1 << 16).select("seq", "accepted", F.spark_partition_id().alias("task"))
        rows = out.groupBy("task").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("int")).alias("taken")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(x["n"] for x in rows) == 40_000 and sum(x["taken"] for x in rows) == 200
    assert max(x["n"] for x in rows) <= 0.35 * 40_000  # four partitions


def test_a_receiver_by_its_environment(spark, tmp_path):
    """Settings, a restart, and the routes over one version of the store."""
    from pulsefold.streaming import receiver as module

    usual = module.from_environment(spark, str(tmp_path / "u"), {"STORE_MAX_EVENTS": "-3", "STORE_MAX_AGE_HOURS": " ", "INGEST_MAX_BODY_BYTES": "x", "AUTH_TOKEN": ""})
    assert (usual.maintenance.max_rows, usual.maintenance.max_age_ms, usual.settings.max_body, usual.settings.token) == (10_000, 0, 1 << 20, None)
    (tmp_path / "package.json").write_text('{"version":"3.1"}')
    own = {"STORE_MAX_EVENTS": "0x10", "STORE_MAX_AGE_HOURS": "0.5", "INGEST_MAX_BODY_BYTES": "0", "AUTH_TOKEN": "t0k"}
    r = module.from_environment(spark, str(tmp_path / "r"), own, str(tmp_path / "package.json"))
    assert (r.maintenance.max_rows, r.maintenance.max_age_ms, r.settings.max_body, r.settings.token, r.version) == (16, 1_800_000, 0, "t0k", "3.1")
    e, auth = VALID["crash"], {"Authorization": "Bearer t0k"}
    long = request(2, [], None, 3000, headers={**auth, "Content-Length": "9999999"})
    r.batch(spark.createDataFrame([request(0, [e], "a", 1000, headers=auth), request(1, [e], "b", 2000), long, request(3, [], None, 4000, body=None, headers=auth)], ingest.REQUEST), 0)
    got = {x["seq"]: (x["status"], x["reason"]) for x in r.outcomes().collect()}
    assert got == {0: (202, None), 1: (401, ingest.REASONS[401]), 2: (202, None), 3: (400, ingest.NO_BODY)}
    again = module.from_environment(spark, str(tmp_path / "r"), own)
    again.batch(spark.createDataFrame([request(4, [e], "a", 5000, headers=auth)], ingest.REQUEST), 1)
    assert again.outcomes().filter("deduped").select("seq").collect() == [(4,)]  # keys outlive the restart
    ask = lambda target, **k: tuple(again.answer(target, 9000, **k).first())
    assert ask("/summary")[0] == ask("/events", authorization="Bearer t0k!")[0] == ask("//", authorization="t0k")[0] == 401
    status, text = ask("/summary", authorization="bearer  t0k")
    body = json.loads(text)
    again.started_at = 0
    assert status == 200 and body["total"] == 1 and body["deduped"]["total"] == 0 and body["seenKeys"]["size"] == 1  # tallies begin with the start
    assert json.loads(ask("/summary", authorization="Bearer t0k")[1])["deduped"]["total"] == 1
    assert json.loads(ask("/capabilities", authorization="Bearer t0k")[1])["authRequired"] is True
    assert [x["receivedAt"] for x in json.loads(ask("/events", authorization="Bearer t0k")[1])["events"]] == [1000]


def test_keys_in_the_state_of_a_stream(spark, tmp_path):
    """Ties, nulls and batches: the outcomes of the whole table, over restarts; what was remembered before counts, too."""
    from pulsefold.streaming import keyed

    rows = [(i, ("a", "b", "", None, f"k{i % 5}")[i % 7 % 5], None if i % 31 == 30 else 3 * (i // 2)) for i in range(240)]
    schema = "seq long, key string, at long"
    source, sink = str(tmp_path / "source"), str(tmp_path / "sink")
    for part in (rows[:80], [], rows[80:160], rows[160:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream = keyed.accepted_stream(spark.readStream.schema(schema).parquet(source), "key", "at", "seq", 20)
        keyed.start(stream, sink, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    got = {r["order"]: r["accepted"] for r in spark.read.parquet(sink).collect()}
    plain = repeats.accepted_arrivals(spark.createDataFrame(rows, schema), "key", "at", "seq", 20)
    assert got == {r["seq"]: r["accepted"] for r in plain.collect()} and len(got) == len(rows)

    entries = spark.createDataFrame([("a", 100), ("a", 50), ("b", None), ("", 900)], "key string, expires_at long")
    late = keyed.accepted_stream(spark.readStream.schema(schema).parquet(source), "key", "at", "seq", 20, entries=entries)
    keyed.start(late, str(tmp_path / "second"), str(tmp_path / "other"), available_now=True).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "second")).filter("accepted AND key IN ('a', 'b', '')").groupBy("key").agg(F.min("at").alias("at")).collect()
    wanted = {k: min(t for _, x, t in rows if (x or "") == k and t is not None and t >= least) for k, least in (("a", 100), ("b", 0), ("", 0))}
    assert {r["key"]: r["at"] for r in first} == wanted
    with pytest.raises(ValueError):
        keyed.accepted_stream(late, "key", "at", "order", 20, keep_ms=10)


def test_tasks_get_files_of_bounded_rows(spark):
    """JSON compresses so well that one file of it would keep one task busy for long."""
    from pulsefold.sources.scratch import written

    df = written(spark.range(10, numPartitions=1), file_rows=3)
    assert len(df.inputFiles()) == 4 and df.count() == 10


def test_texts_are_parsed_and_judged_once(spark):
    """Neither the outcomes of requests nor the filter of typed events computes a text's JSON anew."""
    parses = lambda df: df._jdf.queryExecution().executedPlan().toString().count("parse_json")
    lines = spark.createDataFrame([(0, '{"type":"crash"}')], "seq long, value string")
    assert "Filter" not in ndjson.typed(ndjson.parsed(lines, F.col("seq"))).select("seq")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    e = VALID["crash"]
    requests = spark.createDataFrame([request(0, [e], "a", 1000), request(1, [{}], "a", 1500)], ingest.REQUEST)
    told = ingest.outcomes(requests)
    assert parses(told) == 0
    assert {r["seq"]: (r["status"], r["accepted"]) for r in told.collect()} == {0: (202, 1), 1: (422, 0)}


def test_a_part_has_no_file_for_each_task_and_day(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    day = 86_400_000
    events = spark.range(80, numPartitions=8).select(F.col("id").alias("seq"), F.format_string('{"receivedAt":%d}', F.col("id") % 4 * day).alias("value"))
    store.append(events)
    files = list((tmp_path / "store" / "events").rglob("*.parquet"))
    assert len(files) <= 8 and sum(f.stat().st_size for f in files) < 8 * 100_000  # blooms of the usual size take over 1 MB a column
    assert store.read().count() == 80
