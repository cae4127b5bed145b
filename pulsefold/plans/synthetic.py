"""The `events` table written as telemetry in JSON: log lines and requests that the library's own code reads.

The same columns stand in SQL for DuckDB, so what the library makes of the lines can be held against plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.sources.scratch import written

from .adapter import SQL as ADAPTER
from .adapter import events

#: Rows of one request, and of one file of what is made of the table: JSON compresses so well that a row group of it keeps one task busy for long.
BATCH, FILE_ROWS = 20, 100_000

#: Kind of each event, by its type and k: SQL that both engines read.
KIND = """CASE WHEN type = 'error' THEN 'error' WHEN type = 'purchase' THEN 'crash' WHEN type = 'view' THEN 'performance-stall'
  WHEN type = 'click' AND k % 3 = 0 THEN 'operational-metrics' WHEN type = 'click' AND k % 3 = 1 THEN 'process-memory' WHEN type = 'click' THEN 'feature-usage'
  WHEN k % 3 = 0 THEN 'workspace-names' WHEN k % 3 = 1 THEN 'workspace-shape' ELSE 'server-stall' END"""
#: Platform of each event, by its k, and a name in a workspace, by k and user: SQL that both engines read.
PLATFORM = "CASE k % 4 WHEN 1 THEN 'darwin' WHEN 2 THEN 'linux' WHEN 3 THEN 'win32' END"
CHAT = """CASE WHEN k % 5 = 0 THEN 'chat-' || lpad(CAST("user" AS VARCHAR(20)), 6, '0') ELSE 'n-' || CAST("user" AS VARCHAR(20)) END"""
#: A column more of the adapter's table, in SQL.
SQL = f"""{ADAPTER},
t AS (SELECT seq, ms, mag, k, op, CASE WHEN runtime = 'bogus' THEN 'server' ELSE runtime END AS runtime, app_version, schema_version, "user", {KIND} AS kind, {PLATFORM} AS platform, {CHAT} AS chat,
             CASE WHEN k % 6 = 0 THEN NULL ELSE ms + 7 END AS received, CAST(coalesce(CASE WHEN k % 6 = 0 THEN NULL ELSE ms + 7 END, ms) AS DOUBLE) AS instant FROM a)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"kind": F.expr(KIND), "platform": F.expr(PLATFORM), "chat": F.expr(CHAT.replace('"', "`"))})
    return e.withColumns({"runtime": F.when(F.col("runtime") == "bogus", "server").otherwise(F.col("runtime")), "received": F.when(F.col("k") % 6 != 0, F.col("ms") + 7)})


def _object(**members: Column) -> Column:
    return F.struct(*[x.alias(name) for name, x in members.items()])


def _bodies(e: DataFrame, valid: bool) -> DataFrame:
    """(seq, kind, body): the JSON of each event; members that are null are left out. `valid` writes what the validators accept.

    Each kind is a branch with an expression of its own, which compiles. The rows are written first, so that branches neither read
    the table anew nor have as few tasks as it has row groups. The JSON is written, as a log is.
    """
    e = written(e, file_rows=FILE_ROWS)
    k, mag, user, kind = F.col("k"), F.col("mag"), F.col("user"), F.col("kind")
    common = {"schemaVersion": F.lit(11) if valid else F.col("schema_version"), "type": kind, "runtime": F.col("runtime"), "timestamp": F.col("ms"), "appVersion": F.col("app_version"), "platform": F.col("platform")}
    if not valid:
        common["receivedAt"] = F.col("received")
    window = {"windowStartedAt": F.col("ms") - 1000, "windowEndedAt": F.col("ms")}
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    server, renderer = {"runtime": F.lit("server")}, {"runtime": F.lit("renderer")}
    frame = _object(function=F.when(k % 3 > 0, text("f", k % 4)), file=F.when(k % 5 > 0, F.concat(text("file", k % 3), F.lit(".ts"))), line=F.when(k % 2 > 0, k))
    n = k % 5
    buckets = F.array(*[F.when(F.least(F.floor(mag / 40), F.lit(2)) == i, n).otherwise(F.lit(0)) for i in range(3)])
    operation = lambda held: _object(operation=text("op-", user), count=n, okCount=n - F.when(n > 0, k % 2).otherwise(0), failCount=F.when(n > 0, k % 2).otherwise(0), min=mag, avg=mag + 1, max=mag + 2, buckets=held)
    low = F.floor(mag * 1000)
    wide = F.array(*[F.when(F.least(F.floor(mag / 50), F.lit(1)) == i, n).otherwise(F.lit(0)) for i in range(2)])
    scaled = operation(F.when(k % 10 < 3, wide).otherwise(buckets))
    stalled = F.array(*[F.when(F.least(F.floor(mag / 40), F.lit(2)) == i, n).otherwise(F.lit(0)) for i in range(3)])
    objects = {
        "error": {**common, "name": F.col("op"), "message": F.lit("private"), "frames": F.array(frame)},
        "crash": {**common, "reason": text("r", k % 13), "exitCode": F.when(k % 4 > 0, k % 3)},
        "performance-stall": {**common, "lagMs": mag if valid else F.when(k % 19 > 0, mag), "source": F.lit("event-loop") if valid else text("s", k % 20)},
        "operational-metrics": {**common, **window, "boundaries": F.when(k % 10 < 3, F.array(F.lit(50))).otherwise(F.array(F.lit(40), F.lit(80))), "rejected": k % 4, "rejectedStale": F.when(k % 2 == 0, k % 4), "operations": F.array(scaled)},
        "server-stall": {**common, **server, **window, "count": n, "totalMs": mag * n, "maxMs": mag, "boundaries": F.array(F.lit(40), F.lit(80)), "buckets": stalled, "culprits": F.array(_object(culprit=text("c-", k % 6), count=n, totalOverlapMs=mag))},
        "process-memory": {**common, **window, "samples": k + 1, "rssMinBytes": low, "rssAvgBytes": low + k, "rssMaxBytes": low + 2 * k, "heapUsedMaxBytes": F.when(k % 2 > 0, low), "processAgeMs": k * 10},
        "feature-usage": {**common, **renderer, **window, "features": F.array(_object(name=F.col("op"), count=k + 1), _object(name=text("f-", user), count=k % 3 + 1))},
        "workspace-names": {**common, **server, **window, "chats": F.array(F.col("op"), F.col("chat"), F.col("op")), "chatCount": k + 3, "truncated": k == 98},
        "workspace-shape": {**common, **renderer, **window, "workspaces": k, "panesOpen": k % 7, "panesActive": k % 3, "chats": k % 5, "peakPanesOpen": k % 7 + 1, "peakChats": k % 5 + 2},
    }
    out = None
    for name, members in objects.items():
        part = e.filter(kind == name).select("seq", "kind", F.to_json(_object(**members)).alias("body"))
        out = part if out is None else out.unionByName(part)
    return written(out, file_rows=FILE_ROWS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): the log; every 50th line is torn, every 70th a number."""
    seq = F.col("seq")
    value = F.when(seq % 50 == 7, F.lit('{"type":"err')).when(seq % 70 == 3, F.lit("42")).otherwise(F.col("body"))
    return _bodies(rows(spark, sf_dir), False).select("seq", value.alias("value"))


#: The events that the log's lines hold, in SQL.
LOGGED = SQL + ",\nl AS (SELECT * FROM t WHERE seq % 50 <> 7 AND seq % 70 <> 3)"

#: What is wrong with an event, by the remainder of its number: a pattern in the JSON and what it becomes.
FAULTS = {
    1: (r'"runtime":"[a-z]+"', '"runtime":"cloud"'),
    2: (r'"timestamp":\d+', '"timestamp":"5"'),
    3: (r'"appVersion":"[^"]*"', '"appVersion":null'),
    4: (r'"schemaVersion":11', '"schemaVersion":12'),
    5: (r'"type":"[a-z-]+"', '"type":"unknown"'),
    6: (r'("name":"[^"]*","message":"private"|"reason":"[^"]*"|"lagMs":[0-9.E-]+|"rejected":\d+|"totalMs":[0-9.E-]+|"samples":\d+|"features":\[.*\]|"chatCount":\d+|"workspaces":\d+)', '"gone":1'),
    7: (r'("frames":\[.*\]|"reason":"[^"]*"|"source":"[a-z-]+"|"boundaries":\[[^\]]*\]|"rssMaxBytes":\d+|"count":\d+|"truncated":[a-z]+|"peakChats":\d+)', '"frames":{},"reason":5,"source":"other","boundaries":[80,40],"rssMaxBytes":-1,"count":0.5,"truncated":"no","peakChats":-1'),
}


def judged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, kind, value): one event in twelve with each fault, the others valid."""
    value = F.col("body")
    for i, (pattern, change) in FAULTS.items():
        value = F.when(F.col("seq") % 12 == i, F.regexp_replace("body", pattern, change)).otherwise(value)
    return _bodies(rows(spark, sf_dir), True).select("seq", "kind", value.alias("value"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of BATCH events, some refused by each gate; arrival times repeat keys within and beyond their memory. They are read several times, so they are written."""
    batch = F.floor(F.col("seq") / BATCH)
    value = F.when((batch % 17 == 5) & (F.col("seq") % BATCH == 3), F.lit('{"type":"error"}')).otherwise(F.col("body"))
    each = _bodies(rows(spark, sf_dir), True).select(batch.alias("batch"), F.struct("seq", value.alias("value")).alias("e"))
    bodies = each.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("e"))["value"], ",").alias("list"))  # BATCH events each
    b = F.col("batch")
    version = F.when(b % 13 != 4, F.when(b % 11 == 2, "8").otherwise("11"))
    key = F.when(b % 5 != 0, F.concat(F.lit("k"), (b % 7).cast("string"))).otherwise(F.lit(""))
    headers = F.map_filter(F.create_map(F.lit("X-Telemetry-Schema"), version, F.lit("Idempotency-Key"), key), lambda _, v: v.isNotNull())
    body = F.when(b % 19 == 6, F.lit("{")).otherwise(F.concat(F.lit('{"events":['), "list", F.lit("]}")))
    out = bodies.select(
        b.alias("seq"),
        (b * 50_000).alias("arrived_at_ms"),
        F.when(b % 23 == 7, "GET").otherwise("POST").alias("method"),
        F.when(b % 29 == 8, "//").when(b % 31 == 9, "/other").otherwise("/ingest?x=1").alias("target"),
        headers.alias("headers"),
        F.encode(body, "UTF-8").alias("body"),
    )
    return written(out, file_rows=FILE_ROWS // BATCH)
