"""Queries that read a store: files of lines, typed parts, rollups, pages, retention and the receiver's batches, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.functions.validation import INTRODUCED
from pulsefold.operators.histogram import OVERFLOW
from pulsefold.sources.scratch import scratch_folder
from pulsefold.sources.store import Store, scratch_store
from pulsefold.streaming import keyed
from pulsefold.streaming.receiver import Receiver

from . import pages, summary, synthetic, tallies
from .adapter import SQL as ADAPTER
from .adapter import events
from .catalog import ORACLES as PLAIN
from .catalog import TTL
from .catalog_log import _REQUESTS, _SIGNATURE, _newest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Parts of the store that queries read, and batches of the receiver's.
PARTS, BATCHES = 4, 3

_made: dict[tuple[str, str], Store] = {}


def query(sql: str, base: str = synthetic.LOGGED):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE {base}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}"
        return f

    return add


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The synthetic log, written as text files, several for each of PARTS folders, and loaded one folder after the other; made once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        lines = synthetic.lines(spark, sf_dir)
        least, most = lines.agg(F.min("seq"), F.max("seq")).first()
        width = -(-(most - least + 1) // PARTS)
        out = scratch_store(spark)
        for i in range(PARTS):
            folder = scratch_folder(spark)
            own = lines.filter(F.col("seq").between(least + i * width, least + (i + 1) * width - 1))
            own.repartitionByRange(3, "seq").sortWithinPartitions("seq").select("value").write.text(folder)
            out.load(folder)
        _made[key] = out
    return _made[key]


_FIRST = "b AS (SELECT min(seq) AS first FROM t)"


@query(f"{_FIRST} SELECT l.seq - first AS seq, kind AS type, instant FROM l, b")
def store_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of many files by their order: numbers count all lines, torn ones, too."""
    return store(spark, sf_dir).read().select("seq", "type", "instant")


@query("SELECT CAST(count(*) FILTER (WHERE seq % 50 <> 7) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE seq % 50 = 7) AS BIGINT) AS unreadable, (SELECT CAST(count(*) AS BIGINT) FROM l) AS rows, (SELECT max(instant) FROM l) AS last_instant FROM t")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a version knows without reading an event."""
    s = store(spark, sf_dir).snapshot()
    return spark.createDataFrame([(s.total, s.unreadable, s.rows, s.last_instant)], "total long, unreadable long, rows long, last_instant double")


@query(f"{_FIRST} SELECT l.seq - first AS seq FROM l, b WHERE kind = 'crash' AND app_version = '0.1.5' AND instant >= (SELECT max(ms) FROM t) - 1728000000")
def store_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = float(_newest(spark, sf_dir) - 1_728_000_000)
    return store(spark, sf_dir).snapshot().events(since, type="crash", platform="", app_version="0.1.5").select("seq")


@query(f"{_FIRST} SELECT l.seq - first AS seq, {_SIGNATURE} AS signature FROM l, b WHERE kind = 'crash' AND k % 13 = 4 AND k % 4 > 0 AND k % 3 = 1")
def store_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).snapshot().events(signature="crash:r4:exit=1").select("seq", "signature")


def _first_ten(key: str, name: str, where: str = "TRUE") -> str:
    """SQL of an axis: the ten keys seen first, and the rest together."""
    return f"""SELECT '{name}' AS axis, CASE WHEN rank <= 10 THEN key ELSE '{OVERFLOW}' END AS key, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT *, row_number() OVER (ORDER BY s) AS rank FROM (SELECT {key} AS key, count(*) AS n, min(seq) AS s FROM w WHERE {key} IS NOT NULL AND {where} GROUP BY 1)) GROUP BY 2"""


@query(f"""w AS (SELECT *, 'r' || (k % 13) AS reason FROM l WHERE platform = 'linux'), d(type) AS (VALUES {', '.join(f"('{x}')" for x in INTRODUCED)})
{_first_ten('app_version', 'appVersions')} UNION ALL {_first_ten('reason', 'crashReasons', "kind = 'crash'")}
UNION ALL SELECT 'byType', d.type, CAST(count(w.seq) AS BIGINT) FROM d LEFT JOIN w ON w.kind = d.type GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'topErrorNames', op, CAST(count(*) AS BIGINT) AS n FROM w WHERE kind = 'error' GROUP BY 2 ORDER BY n DESC, op LIMIT 10)
UNION ALL SELECT 'matched', 'all', CAST(count(*) AS BIGINT) FROM w""")
def store_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of one platform from the parts' rollups: no event is read."""
    r = store(spark, sf_dir).snapshot().rollup(platform="linux")
    named = lambda df, axis, key: df.select(F.lit(axis).alias("axis"), (F.lit("all") if key is None else F.col(key)).alias("key"), "n")
    out = named(summary.axis(r, "app_version"), "appVersions", "app_version")
    for df, axis, key in ((summary.crash_reasons(r), "crashReasons", "reason"), (summary.by_type(r), "byType", "type"), (summary.top_error_names(r), "topErrorNames", "name"), (summary.matched(r), "matched", None)):
        out = out.unionByName(named(df, axis, key))
    return out


@query("""w AS (SELECT 's' || (k % 20) AS source, CASE WHEN k % 19 > 0 THEN mag END AS lag FROM l WHERE kind = 'performance-stall'), i AS (SELECT min(instant) AS first_seen, max(instant) AS last_seen FROM l)
SELECT CAST(count(*) AS BIGINT) AS n, round(min(lag), 4) AS low, round(max(lag), 4) AS high, round(coalesce(avg(lag), 0), 4) AS mean, any_value(first_seen) AS first_seen, any_value(last_seen) AS last_seen FROM w, i""")
def store_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes and means that add up over the parts."""
    r = store(spark, sf_dir).snapshot().rollup()
    both = summary.stalls(r).crossJoin(summary.seen(r))  # one row each
    return both.withColumns({c: F.round(c, 4) for c in ("low", "high", "mean")})


@query(f"""{_FIRST}, w AS (SELECT ms, seq FROM l WHERE kind = 'error' AND platform = 'linux' ORDER BY seq DESC LIMIT 30 OFFSET 20)
SELECT ms, (SELECT CAST(count(*) AS BIGINT) FROM l WHERE kind = 'error' AND platform = 'linux') AS matched, (SELECT CAST(count(*) AS BIGINT) FROM t WHERE seq % 50 <> 7) AS total FROM w""")
def store_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of filtered events, sought in the parts that hold it."""
    page = pages.page(store(spark, sf_dir).snapshot(), limit="30", offset="20", type="error", platform="linux")
    return page.select(F.explode("events").alias("e"), "matched", "total").select(F.get_json_object("e", "$.timestamp").cast("long").alias("ms"), "matched", "total")


@query("""b AS (SELECT count(*) AS before FROM a), y AS (SELECT count(*) AS young FROM a WHERE ms >= (SELECT max(ms) FROM a) - 604800000)
SELECT 500::BIGINT AS max_events, CAST(least(young, 500) AS BIGINT) AS retained, CAST(before - least(young, 500) AS BIGINT) AS total_pruned, CAST(least(young, 900) - least(young, 500) AS BIGINT) AS last_pruned, CAST(before - least(young, 500) AS BIGINT) AS in_timeline FROM b, y""", ADAPTER)
def retention_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prunes of a store, told by its versions: by age and count, then by a lower count."""
    e = events(spark, sf_dir).select("seq", "ms")
    own = scratch_store(spark)
    own.append(e.select("seq", F.to_json(F.struct(F.col("ms").alias("receivedAt"))).alias("value")))
    now = e.agg(F.max("ms")).first()[0]
    for rows in (900, 500):
        own.prune(now, rows, 604_800_000)
    tally = tallies.retention_tally(own.snapshot().prunes(tallies.PRUNE), F.lit(now + 1), 500, 604_800_000)
    total = F.aggregate("timeline", F.lit(0).cast("long"), lambda s, x: s + x["n"].cast("long"))
    return tally.select(F.col("configured.max_rows").cast("long").alias("max_events"), "retained", "total_pruned", F.col("last.pruned").alias("last_pruned"), total.alias("in_timeline"))


@query(f"""{_REQUESTS} SELECT seq, status, deduped, CAST(accepted AS INTEGER) AS accepted FROM v""", synthetic.SQL)
def receiver_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of requests that come in several batches: keys are remembered from one to the next."""
    return _received(spark, sf_dir).outcomes().select("seq", "status", "deduped", "accepted")


@query(f"""{_REQUESTS} SELECT CAST(v.ts AS DOUBLE) AS instant, t.kind AS type FROM v JOIN t ON t.seq // {synthetic.BATCH} = v.seq WHERE v.accepted > 0""", synthetic.SQL)
def receiver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that these batches left in the store."""
    return _received(spark, sf_dir).store.read().select("instant", "type")


_receivers: dict[tuple[str, str], Receiver] = {}


def _received(spark: SparkSession, sf_dir: str) -> Receiver:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _receivers:
        requests = synthetic.requests(spark, sf_dir)
        least, most = requests.agg(F.min("seq"), F.max("seq")).first()
        width = -(-(most - least + 1) // BATCHES)
        receiver = Receiver(spark, scratch_folder(spark))
        for i in range(BATCHES):
            receiver.batch(requests.filter(F.col("seq").between(least + i * width, least + (i + 1) * width - 1)), i)
        _receivers[key] = receiver
    return _receivers[key]


def keyed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of each user as a stream that is stopped and started again between its batches, with the keys in its state store."""
    e = events(spark, sf_dir).select("seq", "user", "ms")
    least, most = e.agg(F.min("ms"), F.max("ms")).first()
    width = -(-(most - least + 1) // BATCHES)
    source, sink, checkpoint = (scratch_folder(spark) for _ in range(3))
    for i in range(BATCHES):
        e.filter(F.col("ms").between(least + i * width, least + (i + 1) * width - 1)).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(e.schema).parquet(source)
        keyed.start(keyed.accepted_stream(arrivals, "user", "ms", "seq", TTL), sink, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(sink).select(F.col("order").alias("seq"), F.col("key").cast(e.schema["user"].dataType).alias("user"), "accepted")


QUERIES["keyed_arrivals"], ORACLES["keyed_arrivals"] = keyed_arrivals, PLAIN["dedup_first_seen"]
