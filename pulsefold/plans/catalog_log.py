"""Queries that send synthetic log lines and requests through the library's own parsers, validators, gates and axes, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.functions import validation
from pulsefold.functions import variant as V
from pulsefold.operators.histogram import OVERFLOW
from pulsefold.operators.repeats import live_keys
from pulsefold.sources import ndjson
from pulsefold.sources.scratch import written

from . import ingest, pages, summary, synthetic, tallies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WINDOW_MS, _BUCKETS = 864_000_000, 48


def query(sql: str, base: str = synthetic.LOGGED):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE {base}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}"
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.parsed(synthetic.lines(spark, sf_dir), F.col("seq"))


def _shared(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """`make`, whose table is written once for each application and folder."""
    made: dict[tuple[str, str], DataFrame] = {}

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = written(make(spark, sf_dir))
        return made[key]

    return get


@_shared
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed events; axes read them several times."""
    return ndjson.typed(_log(spark, sf_dir))


def _newest(spark: SparkSession, sf_dir: str) -> int:
    return synthetic.rows(spark, sf_dir).agg(F.max("ms")).first()[0]


def _r(c: str | Column) -> Column:
    return F.round(c, 4)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c) for c in columns})


def _capped(source: str, key: str, cap: int, sums: str, order: str = "seq") -> str:
    """SQL of a bounded histogram: `source` has the key and what `sums` aggregates over the named rows."""
    return f"""f AS (SELECT {key} AS key, min({order}) AS s FROM {source} WHERE {key} IS NOT NULL GROUP BY 1),
o AS (SELECT key, row_number() OVER (ORDER BY s) AS rank FROM f),
c AS (SELECT x.*, CASE WHEN o.rank <= {cap} THEN o.key ELSE '{OVERFLOW}' END AS name FROM {source} x JOIN o ON x.{key} = o.key)
SELECT {sums} FROM c GROUP BY name"""


# the log


@query("SELECT CAST(count(*) FILTER (WHERE seq % 50 <> 7) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE seq % 50 = 7) AS BIGINT) AS unreadable FROM t")
def log_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.unreadable(_log(spark, sf_dir))


_SIGNATURE = """CASE kind WHEN 'error' THEN op || coalesce(' @ ' || nullif(concat_ws(' ', nullif(CASE WHEN k % 5 > 0 THEN 'file' || (k % 3) || '.ts' ELSE '' END || CASE WHEN k % 2 > 0 THEN ':' || k ELSE '' END, ''), CASE WHEN k % 3 > 0 THEN '(f' || (k % 4) || ')' END), ''), '')
  WHEN 'crash' THEN 'crash:r' || (k % 13) || CASE WHEN k % 4 > 0 THEN ':exit=' || (k % 3) ELSE '' END WHEN 'performance-stall' THEN 'stall:s' || (k % 20) END"""
_RUNTIME = "CASE kind WHEN 'feature-usage' THEN 'renderer' WHEN 'workspace-shape' THEN 'renderer' WHEN 'workspace-names' THEN 'server' WHEN 'server-stall' THEN 'server' ELSE runtime END"


@query(f"""SELECT seq, kind AS type, {_RUNTIME} AS runtime, app_version, CAST(schema_version AS VARCHAR) AS schema_version, instant, {_SIGNATURE} AS signature,
  CASE WHEN kind = 'performance-stall' AND k % 19 > 0 THEN round(mag, 4) END AS lag FROM l""")
def log_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_events(spark, sf_dir).select("seq", "type", "runtime", "app_version", "schema_version", "instant", "signature", "lag"), "lag")


@query("SELECT seq FROM l WHERE kind = 'crash' AND app_version = '0.1.5' AND instant >= (SELECT max(ms) FROM t) - 1728000000")
def log_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = float(_newest(spark, sf_dir) - 1_728_000_000)
    return ndjson.filtered(_events(spark, sf_dir), type="crash", since=since, platform="", app_version="0.1.5").select("seq")


@query("SELECT seq FROM l WHERE kind = 'crash' AND k % 13 = 4 AND k % 4 > 0 AND k % 3 = 1")
def log_filtered_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.filtered(_events(spark, sf_dir), signature="crash:r4:exit=1").select("seq")


@query("""p AS (SELECT seq, count(*) OVER () AS matched FROM l WHERE kind = 'error' ORDER BY seq DESC LIMIT 200 OFFSET 150)
SELECT (SELECT count(*) FROM t WHERE seq % 50 <> 7) AS total, CAST(max(matched) AS BIGINT) AS matched, 200 AS "limit", 150 AS "offset", CAST(count(*) AS BIGINT) AS listed FROM p""")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = pages.page(_log(spark, sf_dir), limit="500", offset="150.7", since="", type="error")
    return page.select("total", "matched", "limit", "offset", F.size("events").cast("long").alias("listed"))


# axes


@query(f"d(type) AS (VALUES {', '.join(f"('{x}')" for x in validation.INTRODUCED)}) SELECT d.type, CAST(count(l.seq) AS BIGINT) AS n FROM d LEFT JOIN l ON l.kind = d.type GROUP BY 1")
def log_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_type(_events(spark, sf_dir))


@query(_capped("l", "app_version", 10, "name AS app_version, CAST(count(*) AS BIGINT) AS n"))
def log_app_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.axis(_events(spark, sf_dir), "app_version")


@query(f"x AS (SELECT seq, left(repeat('y', 122) || app_version, 128) AS v FROM l), {_capped('x', 'v', 10, 'name AS app_version, CAST(count(*) AS BIGINT) AS n')}")
def log_long_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are cut before they are counted: versions that begin alike are one."""
    long = _events(spark, sf_dir).withColumn("app_version", F.concat(F.repeat(F.lit("y"), F.lit(122)), F.col("app_version")))
    return summary.axis(long, "app_version")


@query(f"SELECT {_RUNTIME} AS runtime, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1")
def log_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.axis(_events(spark, sf_dir), "runtime")


@query("SELECT CAST(schema_version AS VARCHAR) AS schema_version, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1")
def log_schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.schema_versions(_events(spark, sf_dir))


@query(f"x AS (SELECT seq, 'r' || (k % 13) AS reason FROM l WHERE kind = 'crash'), {_capped('x', 'reason', 10, 'name AS reason, CAST(count(*) AS BIGINT) AS n')}")
def log_crash_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.crash_reasons(_events(spark, sf_dir))


@query("x AS (SELECT op AS name, CAST(count(*) AS BIGINT) AS n FROM l WHERE kind = 'error' GROUP BY 1) SELECT * FROM x ORDER BY n DESC, name LIMIT 10")
def log_top_error_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_error_names(_events(spark, sf_dir))


@query(f"x AS (SELECT {_SIGNATURE} AS signature, kind AS type FROM l) SELECT signature, type, CAST(count(*) AS BIGINT) AS n FROM x WHERE signature IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, signature, type LIMIT 10")
def log_top_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_signatures(_events(spark, sf_dir))


@query("SELECT min(instant) AS first_seen, max(instant) AS last_seen FROM l")
def log_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.seen(_events(spark, sf_dir))


_STALL = "x AS (SELECT seq, instant, 's' || (k % 20) AS source, CASE WHEN k % 19 > 0 THEN mag END AS lag FROM l WHERE kind = 'performance-stall')"
_STALL_SUMS = "CAST(count(*) AS BIGINT) AS n, round(min(lag), 4) AS low, round(max(lag), 4) AS high, round(coalesce(avg(lag), 0), 4) AS mean"


@query(f"{_STALL} SELECT {_STALL_SUMS} FROM x")
def log_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.stalls(_events(spark, sf_dir)), "low", "high", "mean")


@query(f"{_STALL}, {_capped('x', 'source', 10, f'name AS source, {_STALL_SUMS}')}")
def log_stalls_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.stalls_by_source(_events(spark, sf_dir)), "low", "high", "mean")


_OPERATION = """x AS (SELECT seq, 'op-' || "user" AS op, k % 5 AS n, k % 5 - (k % 5 > 0)::INT * (k % 2) AS ok, mag, least(CAST(floor(mag / 40) AS INTEGER), 2) AS i, ms, k, runtime FROM l WHERE kind = 'operational-metrics')"""


@query(f"""{_OPERATION}, {_capped('x', 'op', 129, '''name, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(ok) AS DOUBLE) AS ok, CAST(sum(n - ok) AS DOUBLE) AS fail, round(min(mag) FILTER (WHERE n > 0), 4) AS low,
  round(max(mag + 2) FILTER (WHERE n > 0), 4) AS high, round(CASE WHEN sum(n) > 0 THEN sum((mag + 1) * n) / sum(n) ELSE 0 END, 4) AS mean''')}""")
def log_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.operations(_events(spark, sf_dir)), "low", "high", "mean")


@query(f"""{_OPERATION}, f AS (SELECT op, row_number() OVER (ORDER BY min(seq)) AS rank FROM x GROUP BY 1),
c AS (SELECT CASE WHEN rank <= 129 THEN x.op ELSE '{OVERFLOW}' END AS name, k % 10 < 3 AS wide, CASE WHEN k % 10 < 3 THEN least(CAST(floor(mag / 50) AS INTEGER), 1) ELSE i END AS i, n, seq FROM x JOIN f ON x.op = f.op),
g AS (SELECT name, wide, sum(n) AS held, min(seq) FILTER (WHERE n > 0) AS first, coalesce(sum(n) FILTER (WHERE i = 0), 0) AS a, coalesce(sum(n) FILTER (WHERE i <= 1), 0) AS b FROM c GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY held DESC, first) AS r, sum(held) OVER (PARTITION BY name) AS everything FROM g WHERE held > 0)
SELECT d.name, CAST(coalesce(held, 0) AS DOUBLE) AS n, CAST(coalesce(everything - held, 0) AS DOUBLE) AS excluded, CAST(CASE WHEN wide THEN 1 WHEN NOT wide THEN 2 END AS BIGINT) AS boundaries, CAST(CASE WHEN wide THEN 2 WHEN NOT wide THEN 3 END AS BIGINT) AS buckets,
  {', '.join(f"CASE WHEN a >= ceil(held * {p} / 100.0) THEN CASE WHEN wide THEN 50.0::DOUBLE ELSE 40.0::DOUBLE END WHEN NOT wide AND b >= ceil(held * {p} / 100.0) THEN 80.0::DOUBLE END AS p{p}" for p in (50, 95, 99))}
FROM (SELECT DISTINCT name FROM c) d LEFT JOIN h ON h.name = d.name AND r = 1""")
def log_operation_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scales for each name: the fuller one is reported, the other excluded."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(c)
    return summary.operation_latency(_events(spark, sf_dir)).select("name", "n", "excluded", size("boundaries"), size("buckets"), "p50", "p95", "p99")


@query("""x AS (SELECT unnest(['workspaces', 'panesOpen', 'panesActive', 'chats', 'peakPanesOpen', 'peakChats']) AS measure, CAST(unnest([k, k % 7, k % 3, k % 5, k % 7 + 1, k % 5 + 2]) AS DOUBLE) AS x FROM l WHERE kind = 'workspace-shape')
SELECT measure, CAST(count(x) AS BIGINT) AS windows, min(x) AS low, max(x) AS high, round(avg(x), 4) AS mean FROM x GROUP BY 1""")
def log_workspace_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.workspace_shape(_events(spark, sf_dir)), "mean")


_NAMES = """x AS (SELECT seq, seq * 2 AS place, op AS chat FROM l WHERE kind = 'workspace-names' UNION ALL SELECT seq, seq * 2 + 1, chat FROM l WHERE kind = 'workspace-names')"""


@query(f"{_NAMES}, {_capped('x', 'chat', 200, 'name, CAST(count(DISTINCT seq) AS BIGINT) AS windows', 'place')}")
def log_workspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.workspace_names(_events(spark, sf_dir))


@query(f"""{_NAMES}, f AS (SELECT chat, row_number() OVER (ORDER BY min(place)) AS rank FROM x GROUP BY 1), g AS (SELECT count(*) AS names, count(*) FILTER (WHERE rank <= 200) AS considered, count(*) FILTER (WHERE rank <= 200 AND chat LIKE 'chat-%') AS generated FROM f)
SELECT CAST(least(names, 201) AS BIGINT) AS distinct_count, CAST(considered AS BIGINT) AS considered, CAST(generated AS BIGINT) AS generated, generated::DOUBLE / considered AS share FROM g""")
def log_generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.generated_shaped(_events(spark, sf_dir))


@query("SELECT CAST(max(k + 3) AS DOUBLE) AS max_chat_count, CAST(arg_max(k + 3, ms * 1000000 + seq) AS DOUBLE) AS last_chat_count, bool_or(k = 98) AS truncated_ever, CAST(max(ms) AS DOUBLE) AS last_snapshot_at FROM l WHERE kind = 'workspace-names'")
def log_workspace_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.workspace_latest(_events(spark, sf_dir))


_FEATURES = """x AS (SELECT seq, seq * 2 AS place, op AS feature, k + 1 AS uses FROM l WHERE kind = 'feature-usage' UNION ALL SELECT seq, seq * 2 + 1, 'f-' || "user", k % 3 + 1 FROM l WHERE kind = 'feature-usage')"""


@query(f"{_FEATURES}, {_capped('x', 'feature', 64, 'name, CAST(sum(uses) AS DOUBLE) AS uses, CAST(count(DISTINCT seq) AS BIGINT) AS windows', 'place')}")
def log_feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.feature_usage(_events(spark, sf_dir))


@query(f"{_FEATURES} SELECT CAST(least(count(DISTINCT feature), 65) AS BIGINT) AS distinct_count, (SELECT CAST(max(ms) AS DOUBLE) FROM l WHERE kind = 'feature-usage') AS last_window_at FROM x")
def log_feature_usage_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.feature_usage_seen(_events(spark, sf_dir))


_DIMENSION = "d(runtime) AS (VALUES ('main'), ('renderer'), ('server'))"


@query(f"""{_DIMENSION}, x AS (SELECT runtime, CAST(ms AS DOUBLE) AS ended, k + 1 AS samples, CAST(floor(mag * 1000) AS DOUBLE) AS low, k, k * 10.0::DOUBLE AS age FROM l WHERE kind = 'process-memory'),
p AS (SELECT *, row_number() OVER (PARTITION BY runtime ORDER BY low + 2 * k DESC, ended DESC, age DESC) AS peak, row_number() OVER (PARTITION BY runtime ORDER BY ended DESC, low + 2 * k DESC, age DESC, low + k DESC) AS latest FROM x)
SELECT d.runtime, CAST(count(p.samples) AS BIGINT) AS windows, CAST(sum(samples) AS DOUBLE) AS samples, min(low) AS low, max(low + 2 * k) AS high, CAST(floor(sum((low + k) * samples) / sum(samples) + 0.5) AS BIGINT) AS mean,
  max(CASE WHEN k % 2 > 0 THEN low END) AS heap, max(ended) FILTER (WHERE peak = 1) AS peak_ended, max(age) FILTER (WHERE peak = 1) AS peak_age, max(low + 2 * k) FILTER (WHERE latest = 1) AS latest_high, max(low + k) FILTER (WHERE latest = 1) AS latest_mid
FROM d LEFT JOIN p ON p.runtime = d.runtime GROUP BY 1""")
def log_process_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = summary.process_memory(_events(spark, sf_dir))
    return m.select("runtime", "windows", "samples", "low", "high", F.col("mean").cast("long").alias("mean"), "heap", F.col("peak.ended").alias("peak_ended"), F.col("peak.age").alias("peak_age"), F.col("latest.high").alias("latest_high"), F.col("latest.mid").alias("latest_mid"))


@query(f"""{_DIMENSION}, {_OPERATION} SELECT d.runtime, CAST(count(x.seq) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE k % 4 > 0) AS BIGINT) AS with_rejections, CAST(sum(k % 4) AS BIGINT) AS rejected,
  CAST(sum(CASE WHEN k % 2 = 0 THEN k % 4 END) AS BIGINT) AS stale, CAST(max(ms) FILTER (WHERE k % 4 > 0) AS DOUBLE) AS last_rejected_at FROM d LEFT JOIN x ON x.runtime = d.runtime GROUP BY 1""")
def log_operation_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.operation_rejections(_events(spark, sf_dir)).drop("invalid")


@query("SELECT platform, CAST(count(*) AS BIGINT) AS n FROM l WHERE platform IS NOT NULL GROUP BY 1")
def log_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.axis(_events(spark, sf_dir), "platform")


@query(_capped("l", "app_version", 64, "name AS release, CAST(count(*) AS BIGINT) AS n, min(instant) AS first_seen, max(instant) AS last_seen"))
def log_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.releases(_events(spark, sf_dir))


@query('SELECT arg_max(app_version, "user") AS newest, CAST(count(DISTINCT app_version) AS BIGINT) AS distinct_count FROM l')
def log_newest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.newest_release(_events(spark, sf_dir))


@query(f"""d(type, introduced) AS (VALUES {', '.join(f"('{x}', {v})" for x, v in validation.INTRODUCED.items())}),
y AS (SELECT d.type, d.introduced, CAST(count(*) FILTER (WHERE schema_version >= introduced) AS BIGINT) AS eligible, CAST(count(*) FILTER (WHERE kind = d.type) AS BIGINT) AS emitted FROM d, l GROUP BY 1, 2)
SELECT *, CASE WHEN emitted > 0 THEN 'emitting' WHEN eligible > 0 THEN 'eligible-silent' ELSE 'no-eligible-builds' END AS verdict FROM y""")
def log_type_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.type_reach(_events(spark, sf_dir))


_AT = f"n AS (SELECT max(ms) - 3600000 AS now FROM t), g AS (SELECT l.*, now, least(CAST(floor((instant - (now - {_WINDOW_MS})) / {_WINDOW_MS / _BUCKETS}::DOUBLE) AS BIGINT), {_BUCKETS - 1}) AS bucket FROM l, n WHERE instant >= now - {_WINDOW_MS} AND instant <= now)"


@query(f"{_AT} SELECT bucket, CAST(now - {_WINDOW_MS} + bucket * {_WINDOW_MS // _BUCKETS} AS BIGINT) AS bucket_start, CAST(now - {_WINDOW_MS} + (bucket + 1) * {_WINDOW_MS // _BUCKETS} AS BIGINT) AS bucket_end, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY bucket, now")
def log_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.timeline(_events(spark, sf_dir), _newest(spark, sf_dir) - 3_600_000, _WINDOW_MS, _BUCKETS)


@query(f"""{_AT}, x AS (SELECT bucket, 's' || (k % 20) AS source, min(seq) AS s, count(*) AS n, max(CASE WHEN k % 19 > 0 THEN mag END) AS high FROM g WHERE kind = 'performance-stall' GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY s) AS rank FROM x)
SELECT bucket, CASE WHEN rank <= 10 THEN source ELSE '{OVERFLOW}' END AS source, CAST(sum(n) AS BIGINT) AS n, round(max(high), 4) AS high FROM o GROUP BY 1, 2""")
def log_stalls_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.stalls_timeline(_events(spark, sf_dir), _newest(spark, sf_dir) - 3_600_000, _WINDOW_MS, _BUCKETS), "high")


# validity and admission


@query(f"SELECT seq, seq % 12 NOT BETWEEN 1 AND {max(synthetic.FAULTS)} AS valid FROM t", synthetic.SQL)
def event_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = synthetic.judged_events(spark, sf_dir)
    return e.select("seq", validation.is_valid(V.parse_strict(F.col("value"))).alias("valid"))


@_shared
def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of the requests; tallies read them several times."""
    return ingest.outcomes(synthetic.requests(spark, sf_dir))


_REQUESTS = f"""b AS (SELECT seq // {synthetic.BATCH} AS b, CAST(count(*) AS INTEGER) AS events, bool_or(seq % {synthetic.BATCH} = 3) AS third FROM t GROUP BY 1),
j AS (SELECT b, b * 50000 AS ts, events, CASE WHEN b % 29 = 8 THEN 400 WHEN b % 23 = 7 OR b % 31 = 9 THEN 404 WHEN b % 13 = 4 OR b % 11 = 2 THEN 415 WHEN b % 19 = 6 THEN 400 WHEN b % 17 = 5 AND third THEN 422 ELSE 202 END AS status,
      CASE WHEN b % 5 <> 0 THEN 'k' || (b % 7) END AS key FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, b) AS r FROM j WHERE status = 202 AND key IS NOT NULL),
h AS (SELECT b, ts, key, r, ts + {ingest.TTL_MS} AS until, TRUE AS taken FROM o WHERE r = 1
  UNION ALL SELECT o.b, o.ts, o.key, o.r, CASE WHEN o.ts >= h.until THEN o.ts + {ingest.TTL_MS} ELSE h.until END, o.ts >= h.until FROM h JOIN o ON o.key = h.key AND o.r = h.r + 1),
v AS (SELECT j.b AS seq, j.ts, j.status, CASE WHEN b % 13 = 4 THEN NULL WHEN b % 11 = 2 THEN '8' ELSE '11' END AS declared, j.status = 202 AND NOT coalesce(h.taken, true) AS deduped, CASE WHEN j.status = 202 AND coalesce(h.taken, true) THEN events ELSE 0 END AS accepted FROM j LEFT JOIN h USING (b))"""


@query(f"{_REQUESTS} SELECT seq, status, deduped, CAST(accepted AS INTEGER) AS accepted FROM v", synthetic.SQL)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.outcomes(synthetic.requests(spark, sf_dir)).select("seq", "status", "deduped", "accepted")


@query(f"{_REQUESTS} SELECT v.seq AS request, CAST(row_number() OVER (PARTITION BY v.seq ORDER BY t.seq) - 1 AS INTEGER) AS position, CAST(v.ts AS DOUBLE) AS instant, t.kind AS type FROM v JOIN t ON t.seq // {synthetic.BATCH} = v.seq WHERE v.accepted > 0", synthetic.SQL)
def admitted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the log, read back from their JSON: the stamp is the instant."""
    rows = ingest.log_rows(ingest.admitted(synthetic.requests(spark, sf_dir)))
    back = ndjson.typed(ndjson.parsed(rows.select((F.col("request") * 1000 + F.col("position")).alias("at"), "value"), F.col("at")))
    return back.select(F.floor(F.col("seq") / 1000).alias("request"), (F.col("seq") % 1000).cast("int").alias("position"), "instant", "type")


@query(f"""{_REQUESTS} SELECT CAST(count(*) AS BIGINT) AS total, arg_max(status, ts) AS last_status, max(ts) AS last_seen, CAST(count(*) FILTER (WHERE status = 415 AND declared = '8') AS BIGINT) AS of_version_8, CAST(count(DISTINCT status) AS BIGINT) AS statuses FROM v WHERE status <> 202""", synthetic.SQL)
def rejection_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = tallies.rejection_tally(_outcomes(spark, sf_dir), F.lit(10**9))
    return tally.select("total", "last_status", "last_seen", F.filter("by_declared_version", lambda x: x["key"] == "8")[0]["n"].alias("of_version_8"), F.size("by_status").cast("long").alias("statuses"))


@query(f"{_REQUESTS} SELECT CAST(count(*) AS BIGINT) AS total, max(ts) AS last_seen FROM v WHERE deduped", synthetic.SQL)
def dedup_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.dedup_tally(_outcomes(spark, sf_dir), F.lit(10**9)).select("total", "last_seen")


@query(f"""{_REQUESTS}, r AS (SELECT max(ts) AS last_rejection_at, string_agg(DISTINCT declared, ',' ORDER BY declared) FILTER (WHERE status = 415 AND declared <> '11') AS mismatched FROM v WHERE status <> 202)
SELECT max(ms) AS last_accepted_at, 5000::BIGINT AS age_ms, true AS accepted_since_boot, any_value(r.last_rejection_at) AS last_rejection_at, any_value(r.mismatched) AS mismatched FROM t, r""", synthetic.SQL)
def liveness_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = _newest(spark, sf_dir)
    accepted = synthetic.rows(spark, sf_dir).agg(F.max("ms").alias("last_accepted_at"))
    row = tallies.liveness_row(accepted, _outcomes(spark, sf_dir), F.lit(1), F.lit(newest + 5000))
    return row.select("last_accepted_at", "age_ms", "accepted_since_boot", "last_rejection_at", F.array_join("mismatched_versions", ",").alias("mismatched"))


@query(f"""{_REQUESTS} SELECT seq, CASE WHEN seq % 7 = 3 THEN 401 WHEN status IN (404, 415) OR seq % 29 = 8 THEN status WHEN seq * 10000 > {ingest.MAX_BODY} THEN 413 ELSE status END AS status FROM v""", synthetic.SQL)
def admission_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receiver with a token; bodies that say they are too long are refused before they are read."""
    r = synthetic.requests(spark, sf_dir)
    more = F.create_map(F.lit("authorization"), F.when(F.col("seq") % 7 == 3, "Bearer other").otherwise("bearer  t0k "), F.lit("Content-Length"), (F.col("seq") * 10_000).cast("string"))
    return ingest.judged(r.withColumn("headers", F.map_concat("headers", more)), ingest.Settings(token="t0k")).select("seq", "status")


@query(f"{_REQUESTS} SELECT seq, CASE WHEN status = 202 AND NOT deduped THEN 503 ELSE status END AS status, 0::INTEGER AS accepted FROM v", synthetic.SQL)
def not_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.not_stored(_outcomes(spark, sf_dir)).select("seq", "status", "accepted")


@query(f"{_REQUESTS} SELECT CAST(count(*) AS BIGINT) AS total, '{ingest.REASONS[503]}' AS last_reason, max(ts) AS last_seen FROM v WHERE status = 202 AND NOT deduped", synthetic.SQL)
def persist_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.persist_tally(ingest.not_stored(_outcomes(spark, sf_dir)), F.lit(10**9)).select("total", "last_reason", "last_seen")


@query(f"{_REQUESTS} SELECT CAST(least(count(*), 10000) AS BIGINT) AS size, 10000 AS max_keys FROM h WHERE taken AND ts + {ingest.TTL_MS} > (SELECT max(ts) FROM v)", synthetic.SQL)
def seen_key_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _outcomes(spark, sf_dir)
    live = live_keys(ingest.live_entries(outcomes), outcomes.agg(F.max("arrived_at_ms")).first()[0])
    return tallies.seen_key_tally(live).select("size", F.col("configured.max_keys").alias("max_keys"))
