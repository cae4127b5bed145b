"""All queries by name over the test tables, with their SQL.

Each query applies one operator of the library to the whole `events` table seen as telemetry and returns plain
rows, so the SQL of another engine can be held against it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.functions import keys, numbers
from pulsefold.sources.store import scratch_store
from pulsefold.operators import grid, histogram, repeats, retention

from .adapter import BOUNDARIES, SQL, events, latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Types of the adapter, with one that no event has, and the schema version that introduced each.
TYPES = {"click": 1, "crash": 1, "error": 5, "purchase": 7, "signup": 9, "view": 10}
RUNTIMES = ("main", "renderer", "server")
OVER = histogram.OVERFLOW


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {SQL}{',' if sql.lstrip()[0] != '!' else ''} {sql.lstrip().lstrip('!')}"
        return f

    return add


def _dimension(spark: SparkSession, values, column: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _r(x: Column) -> Column:
    return F.round(x, 4)


# scans, filters, counts


@query("! SELECT seq, ms, type FROM a")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", "ms", "type")


@query("! SELECT seq, ms, type, app_version, runtime FROM a WHERE type = 'purchase' AND runtime = 'main' AND ms >= (SELECT max(ms) FROM a) - 864000000")
def filter_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.filter((F.col("type") == "purchase") & (F.col("runtime") == "main") & (F.col("ms") >= latest(e) - 864_000_000)).select("seq", "ms", "type", "app_version", "runtime")


@query("! SELECT seq, ms FROM a WHERE ms >= (SELECT max(ms) FROM a) - 86400000")
def filter_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.filter(F.col("ms") >= latest(e) - 86_400_000).select("seq", "ms")


@query("! SELECT t.type, CAST(count(a.seq) AS BIGINT) AS n FROM (VALUES ('click'), ('crash'), ('error'), ('purchase'), ('signup'), ('view')) t(type) LEFT JOIN a ON a.type = t.type GROUP BY t.type")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return _dimension(spark, TYPES, "type").join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


@query("! SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE type = 'error' AND runtime = 'server') AS BIGINT) AS matched FROM a")
def total_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if((F.col("type") == "error") & (F.col("runtime") == "server")).alias("matched"))


@query("! SELECT min(ms) AS first_seen, max(ms) AS last_seen FROM a WHERE type = 'view'")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("type = 'view'").agg(F.min("ms").alias("first_seen"), F.max("ms").alias("last_seen"))


# rankings and bounded histograms


@query("! SELECT op AS name, CAST(count(*) AS BIGINT) AS n FROM a WHERE type = 'error' GROUP BY op ORDER BY n DESC, name LIMIT 10")
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.top_k(events(spark, sf_dir).filter("type = 'error'").select(keys.bounded_key(F.col("op")).alias("name")), ["name"], 10)


def signed(e: DataFrame) -> DataFrame:
    """The events with the signature that they would have as failures: purchases crash and views stall."""
    kind = F.when(F.col("type") == "purchase", "crash").when(F.col("type") == "view", "performance-stall").otherwise(F.col("type"))
    k = F.col("k")
    place = keys.frame_place(F.when(k % 3 > 0, F.concat(F.lit("f"), (k % 4).cast("string"))), F.when(k % 5 > 0, F.concat(F.lit("file"), (k % 3).cast("string"), F.lit(".ts"))), F.when(k % 2 > 0, k))
    return e.withColumn("signature", keys.signature(kind, F.col("op"), place, F.when(k % 10 > 0, F.concat(F.lit("r"), (k % 6).cast("string"))).otherwise(F.lit("")), F.when(k % 4 > 0, k % 3), F.concat(F.lit("s"), (k % 2).cast("string"))))


SIGNED = """s AS (
  SELECT *, CASE
    WHEN type = 'error' THEN op || coalesce(' @ ' || CASE WHEN p = '' THEN f WHEN f IS NULL THEN p ELSE p || ' ' || f END, '')
    WHEN type = 'purchase' AND k % 10 > 0 THEN 'crash:r' || (k % 6) || CASE WHEN k % 4 > 0 THEN ':exit=' || (k % 3) ELSE '' END
    WHEN type = 'view' THEN 'stall:s' || (k % 2) END AS signature
  FROM (SELECT *, CASE WHEN k % 3 > 0 THEN '(f' || (k % 4) || ')' END AS f,
               CASE WHEN k % 5 > 0 THEN 'file' || (k % 3) || '.ts' ELSE '' END || CASE WHEN k % 2 > 0 THEN ':' || k ELSE '' END AS p FROM a))"""


@query(f"{SIGNED} SELECT signature, type, CAST(count(*) AS BIGINT) AS n FROM s WHERE signature IS NOT NULL AND signature <> '' GROUP BY signature, type ORDER BY n DESC, signature, type LIMIT 10")
def top_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.top_k(signed(events(spark, sf_dir)), ["signature", "type"], 10)


@query(f"""{SIGNED}, top AS (SELECT signature FROM s WHERE signature IS NOT NULL GROUP BY signature, type ORDER BY count(*) DESC, signature, type LIMIT 1)
SELECT seq, signature FROM s WHERE signature IN (SELECT signature FROM top)""")
def signature_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signed(events(spark, sf_dir))
    top = histogram.top_k(s, ["signature", "type"], 1).select("signature")
    return s.join(top, "signature", "left_semi").select("seq", "signature")


@query("! SELECT CAST(schema_version AS VARCHAR) AS version, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1")
def hist_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("schema_version").cast("string").alias("version")).agg(F.count("*").alias("n"))


def _capped_sql(key: str, cap: int, where: str = "TRUE") -> str:
    return f"""r AS (SELECT {key} AS key, min(seq) AS s, count(*) AS n FROM a WHERE {where} GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY s) AS k FROM r)
SELECT CASE WHEN k <= {cap} THEN key ELSE '{OVER}' END AS key, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1"""


def _capped(e: DataFrame, column: Column, cap: int) -> DataFrame:
    return histogram.bounded_histogram(e.select(keys.bounded_key(column).alias("key"), "seq"), "key", ["seq"], cap)


@query(_capped_sql("op", 10))
def hist_capped_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(events(spark, sf_dir), F.col("op"), 10)


@query(_capped_sql("runtime", 10))
def hist_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(events(spark, sf_dir), F.col("runtime"), 10)


@query(_capped_sql("'r' || (k % 13)", 10, "type = 'purchase'"))
def crash_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(events(spark, sf_dir).filter("type = 'purchase'"), F.concat(F.lit("r"), (F.col("k") % 13).cast("string")), 10)


@query(_capped_sql("CAST(\"user\" AS VARCHAR)", 129))
def hist_capped_129(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(events(spark, sf_dir), F.col("user").cast("string"), 129)


# statistics


def finite_stats(value: Column) -> dict[str, tuple[Column, str]]:
    """Aggregates of a measure, by name, with the function that merges them: all rows count, statistics skip what is not finite."""
    v = numbers.when_finite(value)
    return {"n": (F.count("*"), "sum"), "low": (F.min(v), "min"), "high": (F.max(v), "max"), "total": (F.sum(v), "sum"), "usable": (F.count(v), "sum")}


def averaged(df: DataFrame) -> DataFrame:
    mean = F.when(F.col("usable") > 0, F.col("total") / F.col("usable")).otherwise(F.lit(0.0))
    return df.withColumns({"low": _r(F.col("low")), "high": _r(F.col("high")), "mean": _r(mean)}).drop("total", "usable")


#: Magnitudes with unusable values among them.
def _lag() -> Column:
    return F.when(F.col("k") % 17 == 0, F.lit(float("nan"))).when(F.col("k") % 19 == 0, F.lit(None)).otherwise(F.col("mag"))


LAG = "l AS (SELECT *, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL ELSE mag END AS lag FROM a WHERE type = 'error')"


@query(f"{LAG} SELECT CAST(count(*) AS BIGINT) AS n, round(min(lag), 4) AS low, round(max(lag), 4) AS high, round(coalesce(avg(lag), 0), 4) AS mean FROM l")
def stall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("type = 'error'").withColumn("lag", _lag())
    return averaged(e.agg(*[a.alias(n) for n, (a, _) in finite_stats(F.col("lag")).items()]))


@query(f"""{LAG}, r AS (SELECT op AS source, min(seq) AS s, count(*) AS n, min(lag) AS low, max(lag) AS high, sum(lag) AS total, count(lag) AS usable FROM l GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY s) AS k FROM r)
SELECT CASE WHEN k <= 10 THEN source ELSE '{OVER}' END AS source, CAST(sum(n) AS BIGINT) AS n, round(min(low), 4) AS low, round(max(high), 4) AS high,
       round(CASE WHEN sum(usable) > 0 THEN sum(total) / sum(usable) ELSE 0 END, 4) AS mean FROM o GROUP BY 1""")
def stall_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("type = 'error'").withColumn("lag", _lag()).withColumn("source", F.col("op"))
    return averaged(histogram.bounded_histogram(e, "source", ["seq"], 10, finite_stats(F.col("lag"))))


@query(f"""r AS (SELECT 'op-' || "user" AS op, min(seq) AS s, sum(k % 5) AS n, sum(k % 5 - k % 2 * (k % 5 > 0)::INT) AS ok, min(CASE WHEN k % 5 > 0 THEN mag END) AS low,
             max(CASE WHEN k % 5 > 0 THEN mag END) AS high, sum(mag * (k % 5)) AS weighted FROM a GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY s) AS k FROM r)
SELECT CASE WHEN k <= 129 THEN op ELSE '{OVER}' END AS op, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ok) AS BIGINT) AS ok, round(min(low), 4) AS low, round(max(high), 4) AS high,
       round(CASE WHEN sum(n) > 0 THEN sum(weighted) / sum(n) ELSE 0 END, 4) AS mean FROM o GROUP BY 1""")
def operations_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means weighted by count; a window without an operation gives no extremes."""
    count = F.col("k") % 5
    ok = count - F.when(count > 0, F.col("k") % 2).otherwise(0)
    e = events(spark, sf_dir).withColumn("op", F.concat(F.lit("op-"), F.col("user").cast("string")))
    seen = F.when(count > 0, numbers.when_finite(F.col("mag")))
    table = histogram.bounded_histogram(
        e, "op", ["seq"], 129,
        {"n": (F.sum(count), "sum"), "ok": (F.sum(ok), "sum"), "low": (F.min(seen), "min"), "high": (F.max(seen), "max"), "weighted": (F.sum(numbers.when_finite(F.col("mag")) * count), "sum")},
    )
    mean = F.when(F.col("n") > 0, F.col("weighted") / F.col("n")).otherwise(F.lit(0.0))
    return table.select("op", F.col("n").cast("long").alias("n"), F.col("ok").cast("long").alias("ok"), _r(F.col("low")).alias("low"), _r(F.col("high")).alias("high"), _r(mean).alias("mean"))


_LATENCY = f"""b AS (SELECT i, x FROM (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(BOUNDARIES))}, ({len(BOUNDARIES)}, NULL)) t(i, x)),
m AS (SELECT type, (SELECT coalesce(min(i), {len(BOUNDARIES)}) FROM b WHERE x >= mag * 37) AS i FROM a),
c AS (SELECT t.type, b.i, b.x, count(m.i) AS n FROM (SELECT DISTINCT type FROM a) t CROSS JOIN b LEFT JOIN m ON m.type = t.type AND m.i = b.i GROUP BY ALL)"""


def _buckets(e: DataFrame) -> DataFrame:
    spark = e.sparkSession
    grid_ = spark.createDataFrame([(i, x) for i, x in enumerate((*BOUNDARIES, None))], "bucket int, boundary int")
    placed = e.groupBy("type", histogram.bucket_index(F.col("mag") * 37, BOUNDARIES).alias("bucket")).agg(F.count("*").alias("n"))
    types = placed.select("type").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(BOUNDARIES)))))
    return types.join(F.broadcast(grid_), "bucket").join(placed, ["type", "bucket"], "left").select("type", "bucket", "boundary", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{_LATENCY} SELECT type, i AS bucket, x AS boundary, CAST(n AS BIGINT) AS n FROM c")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(events(spark, sf_dir))


@query(f"""{_LATENCY}, u AS (SELECT *, sum(n) OVER (PARTITION BY type ORDER BY i) AS upto, sum(n) OVER (PARTITION BY type) AS total FROM c)
SELECT type, {', '.join(f'min_by(x, i) FILTER (WHERE total > 0 AND upto >= ceil({p} * total / 100.0)) AS p{p}' for p in (50, 95, 99))} FROM u GROUP BY type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.bucket_percentiles(_buckets(events(spark, sf_dir)), ["type"], "bucket", "n", "boundary")


@query("""! SELECT CAST(count(*) AS BIGINT) AS windows, max(ms) AS last_snapshot_at, CAST(count(v) AS BIGINT) AS usable, min(v) AS low, max(v) AS high, round(coalesce(avg(v), 0), 4) AS mean
FROM (SELECT ms, CASE WHEN k % 7 > 0 THEN k END AS v FROM a WHERE type = 'view')""")
def shape_plain_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("k") % 7 > 0, F.col("k"))
    e = events(spark, sf_dir).filter("type = 'view'")
    return e.agg(F.count("*").alias("windows"), F.max("ms").alias("last_snapshot_at"), F.count(v).alias("usable"), F.min(v).alias("low"), F.max(v).alias("high"), _r(F.coalesce(F.avg(v), F.lit(0.0))).alias("mean"))


_NAMES = """w AS (SELECT seq, 0 AS pos, op AS name FROM a UNION ALL SELECT seq, 1, 'n-' || "user" FROM a),
r AS (SELECT name, min(seq * 2 + pos) AS s, count(DISTINCT seq) AS n FROM w GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY s) AS k FROM r)"""


@query(f"{_NAMES} SELECT CASE WHEN k <= 200 THEN name ELSE '{OVER}' END AS name, CAST(sum(n) AS BIGINT) AS windows FROM o GROUP BY 1")
def names_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that hold each name; a name counts once in a window."""
    e = events(spark, sf_dir)
    pairs = e.select("seq", F.explode(F.array_distinct(F.transform(F.array("op", F.concat(F.lit("n-"), F.col("user").cast("string"))), lambda x, i: F.struct(i.alias("pos"), x.alias("name"))))).alias("x")).select("seq", "x.pos", "x.name")
    return histogram.bounded_histogram(pairs, "name", ["seq", "pos"], 200, {"windows": (F.count("*"), "sum")})


@query("! SELECT max(k) AS max_count, max_by(k, ms * 1000000 + seq) AS last_count, CAST(count(DISTINCT op) AS BIGINT) AS names, max(ms) AS last_snapshot_at, bool_or(k = 99) AS truncated_ever FROM a WHERE type = 'signup'")
def names_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest count by the sender's clock, ties by arrival."""
    e = events(spark, sf_dir).filter("type = 'signup'")
    return e.agg(F.max("k").alias("max_count"), F.max_by("k", F.struct("ms", "seq")).alias("last_count"), F.count_distinct("op").alias("names"), F.max("ms").alias("last_snapshot_at"), F.coalesce(F.bool_or(F.col("k") == 99), F.lit(False)).alias("truncated_ever"))


_GENERATED = "g AS (SELECT DISTINCT CASE \"user\" % 4 WHEN 0 THEN 'chat-' || substr(md5(CAST(\"user\" AS VARCHAR)), 1, 6) WHEN 1 THEN 'split-' || substr(md5(CAST(\"user\" AS VARCHAR)), 1, 8) WHEN 2 THEN 'shell-X' || \"user\" ELSE 'demo' || \"user\" END AS name FROM a)"


@query(f"{_GENERATED} SELECT CAST(count(*) AS BIGINT) AS considered, CAST(count(*) FILTER (WHERE regexp_full_match(name, 'chat-[a-z0-9]{{6}}|split-[a-z0-9]{{8}}|shell-[a-z0-9]{{6}}')) AS BIGINT) AS generated FROM g")
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, m = F.col("user"), F.md5(F.col("user").cast("string"))
    name = F.when(u % 4 == 0, F.concat(F.lit("chat-"), F.substring(m, 1, 6))).when(u % 4 == 1, F.concat(F.lit("split-"), F.substring(m, 1, 8))).when(u % 4 == 2, F.concat(F.lit("shell-X"), u.cast("string"))).otherwise(F.concat(F.lit("demo"), u.cast("string")))
    names = events(spark, sf_dir).select(name.alias("name")).distinct()
    return names.agg(F.count("*").alias("considered"), F.count_if(F.col("name").rlike(keys.GENERATED_NAME)).alias("generated"))


@query(f"""w AS (SELECT seq, name, uses FROM (SELECT seq, unnest([op, 'f-' || "user"]) AS name, unnest([k, k % 3]) AS uses FROM a WHERE type IN ('click', 'view')) WHERE uses > 0),
f AS (SELECT name, min(seq * 2 + CASE WHEN name LIKE 'op-%' THEN 0 ELSE 1 END) AS first FROM w GROUP BY 1),
o AS (SELECT name, row_number() OVER (ORDER BY first) AS k FROM f),
n AS (SELECT w.seq, w.uses, CASE WHEN o.k <= 64 THEN w.name ELSE '{OVER}' END AS feature FROM w JOIN o USING (name))
SELECT feature, CAST(sum(uses) AS BIGINT) AS uses, CAST(count(DISTINCT seq) AS BIGINT) AS windows FROM n GROUP BY 1""")
def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and windows by feature; the shared bucket counts a window once, too."""
    e = events(spark, sf_dir).filter("type IN ('click', 'view')")
    rows = e.select("seq", F.posexplode(F.array(F.struct(F.col("op").alias("feature"), F.col("k").alias("uses")), F.struct(F.concat(F.lit("f-"), F.col("user").cast("string")).alias("feature"), (F.col("k") % 3).alias("uses")))).alias("pos", "x"))
    rows = rows.select("seq", "pos", "x.feature", "x.uses").filter("uses > 0")
    first = rows.groupBy("feature").agg(F.min(F.struct("seq", "pos")).alias("f")).orderBy("f").limit(64).select("feature", F.lit(True).alias("own"))
    named = rows.join(F.broadcast(first), "feature", "left").withColumn("feature", F.when(F.col("own"), F.col("feature")).otherwise(F.lit(OVER)))  # broadcast: 64 rows
    by_window = named.groupBy("feature", "seq").agg(F.sum("uses").alias("uses"))
    return by_window.groupBy("feature").agg(F.sum("uses").alias("uses"), F.count("*").alias("windows"))


_MEMORY = "m AS (SELECT runtime, seq, ms, k + 1 AS samples, mag AS low, mag + k AS mid, mag + 2 * k AS high, CASE WHEN k % 3 > 0 THEN mag + k / 2.0::DOUBLE END AS heap, k * 10 AS age FROM a WHERE type = 'click')"


def _memory(e: DataFrame) -> DataFrame:
    k = F.col("k")
    return e.filter("type = 'click'").select("runtime", "seq", "ms", (k + 1).alias("samples"), F.col("mag").alias("low"), (F.col("mag") + k).alias("mid"), (F.col("mag") + 2 * k).alias("high"), F.when(k % 3 > 0, F.col("mag") + k / 2).alias("heap"), (k * 10).alias("age"))


@query(f"""{_MEMORY} SELECT t.runtime, CAST(count(m.seq) AS BIGINT) AS windows, CAST(sum(samples) AS BIGINT) AS samples, round(min(low), 4) AS low, round(max(high), 4) AS high,
  CAST(floor(sum(mid * samples) / sum(samples) + 0.5) AS BIGINT) AS mid, round(max(heap), 4) AS heap
FROM (VALUES ('main'), ('renderer'), ('server')) t(runtime) LEFT JOIN m ON m.runtime = t.runtime GROUP BY t.runtime""")
def memory_by_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample-weighted means, rounded half up; runtimes without a report have nulls."""
    m = _memory(events(spark, sf_dir))
    by = m.groupBy("runtime").agg(F.count("*").alias("windows"), F.sum("samples").alias("samples"), _r(F.min("low")).alias("low"), _r(F.max("high")).alias("high"), numbers.half_up(F.sum(F.col("mid") * F.col("samples")) / F.sum("samples")).alias("mid"), _r(F.max("heap")).alias("heap"))
    return _dimension(spark, RUNTIMES, "runtime").join(by, "runtime", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))


@query(f"{_MEMORY} SELECT runtime, round(high, 4) AS high, ms, age FROM (SELECT *, row_number() OVER (PARTITION BY runtime ORDER BY high DESC, ms DESC, age DESC) AS r FROM m WHERE runtime <> 'bogus') WHERE r = 1")
def memory_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest reading of each runtime; ties by the window's end, then the process age."""
    best = _memory(events(spark, sf_dir)).filter(F.col("runtime").isin(*RUNTIMES)).groupBy("runtime").agg(F.max(F.struct("high", "ms", "age")).alias("b"))
    return best.select("runtime", _r(F.col("b.high")).alias("high"), "b.ms", "b.age")


@query(f"{_MEMORY} SELECT runtime, ms, round(high, 4) AS high, age, round(mid, 4) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY runtime ORDER BY ms DESC, high DESC, age DESC, mid DESC) AS r FROM m WHERE runtime <> 'bogus') WHERE r = 1")
def memory_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _memory(events(spark, sf_dir)).filter(F.col("runtime").isin(*RUNTIMES)).groupBy("runtime").agg(F.max(F.struct("ms", "high", "age", "mid")).alias("b"))
    return best.select("runtime", "b.ms", _r(F.col("b.high")).alias("high"), "b.age", _r(F.col("b.mid")).alias("mid"))


@query("""j AS (SELECT runtime, ms, CASE WHEN k % 11 > 0 THEN k % 4 END AS rejected, CASE WHEN k % 2 = 0 THEN k % 4 END AS stale FROM a WHERE type = 'purchase')
SELECT t.runtime, CAST(count(j.ms) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE rejected > 0) AS BIGINT) AS with_rejections, CAST(sum(rejected) AS BIGINT) AS rejected,
       CAST(sum(stale) AS BIGINT) AS stale, max(j.ms) FILTER (WHERE rejected > 0) AS last_rejected_at
FROM (VALUES ('main'), ('renderer'), ('server')) t(runtime) LEFT JOIN j ON j.runtime = t.runtime GROUP BY t.runtime""")
def rejections_by_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums stay null until a window carries a valid figure."""
    k = F.col("k")
    j = events(spark, sf_dir).filter("type = 'purchase'").select("runtime", "ms", F.when(k % 11 > 0, k % 4).alias("rejected"), F.when(k % 2 == 0, k % 4).alias("stale"))
    by = j.groupBy("runtime").agg(F.count("*").alias("windows"), F.count_if(F.col("rejected") > 0).alias("with_rejections"), F.sum("rejected").alias("rejected"), F.sum("stale").alias("stale"), F.max(F.when(F.col("rejected") > 0, F.col("ms"))).alias("last_rejected_at"))
    out = _dimension(spark, RUNTIMES, "runtime").join(by, "runtime", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("windows", "with_rejections")})


@query(f"""r AS (SELECT app_version AS release, min(seq) AS s, count(*) AS n, min(ms) AS first_seen, max(ms) AS last_seen FROM a GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY s) AS k FROM r)
SELECT CASE WHEN k <= 64 THEN release ELSE '{OVER}' END AS release, CAST(sum(n) AS BIGINT) AS n, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM o GROUP BY 1""")
def releases_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.bounded_histogram(events(spark, sf_dir).withColumn("release", F.col("app_version")), "release", ["seq"], 64, {"n": (F.count("*"), "sum"), "first_seen": (F.min("ms"), "min"), "last_seen": (F.max("ms"), "max")})


@query("! SELECT arg_max(app_version, \"user\") AS newest, CAST(count(DISTINCT app_version) AS BIGINT) AS distinct_count FROM a")
def releases_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = events(spark, sf_dir).groupBy("app_version").agg(F.min("seq").alias("s")).withColumn("o", keys.release_order(F.col("app_version")))
    return labels.agg(F.max_by("app_version", F.when(F.col("o").isNotNull(), F.struct("o", -F.col("s")))).alias("newest"), F.count("*").alias("distinct_count"))


@query(f"""d(type, introduced) AS (VALUES {', '.join(f"('{t}', {v})" for t, v in TYPES.items())})
SELECT d.type, d.introduced, CAST(count(a.seq) FILTER (WHERE a.schema_version >= d.introduced) AS BIGINT) AS eligible, CAST(count(a.seq) FILTER (WHERE a.type = d.type) AS BIGINT) AS emitted,
  CASE WHEN count(a.seq) FILTER (WHERE a.type = d.type) > 0 THEN 'emitting' WHEN count(a.seq) FILTER (WHERE a.schema_version >= d.introduced) > 0 THEN 'eligible-silent' ELSE 'no-eligible-builds' END AS verdict
FROM d LEFT JOIN a ON TRUE GROUP BY d.type, d.introduced""")
def type_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type the events of builds that could have sent it. The join by version meets one row per version and type."""
    dim = spark.createDataFrame(list(TYPES.items()), "type string, introduced int")
    e = events(spark, sf_dir)
    versions = e.groupBy("schema_version").agg(F.count("*").alias("n"))
    # broadcast: a row for each type
    eligible = versions.join(F.broadcast(dim), F.col("schema_version") >= F.col("introduced")).groupBy("type").agg(F.sum("n").alias("eligible"))
    emitted = e.groupBy("type").agg(F.count("*").alias("emitted"))
    out = dim.join(eligible, "type", "left").join(emitted, "type", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("eligible", "emitted")})
    return out.withColumn("verdict", F.when(F.col("emitted") > 0, "emitting").when(F.col("eligible") > 0, "eligible-silent").otherwise("no-eligible-builds"))


# time

_NOW = "n AS (SELECT max(ms) - 3600000 AS now FROM a)"
WINDOW_MS, SLOTS = 864_000_000, 48


def _now(e: DataFrame) -> Column:
    return latest(e) - 3_600_000


@query(f"""{_NOW}, t AS (SELECT least(CAST(floor((ms - (now - {WINDOW_MS})) / {WINDOW_MS / SLOTS}::DOUBLE) AS BIGINT), {SLOTS - 1}) AS bucket, now FROM a, n WHERE ms >= now - {WINDOW_MS} AND ms <= now)
SELECT bucket, CAST(now - {WINDOW_MS} + bucket * {WINDOW_MS // SLOTS} AS BIGINT) AS bucket_start, CAST(now - {WINDOW_MS} + (bucket + 1) * {WINDOW_MS // SLOTS} AS BIGINT) AS bucket_end, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY bucket, now""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return grid.now_grid(e, "ms", _now(e), WINDOW_MS, SLOTS).groupBy("bucket", "bucket_start", "bucket_end").agg(F.count("*").alias("n"))


@query(f"""{_NOW}, t AS (SELECT least(CAST(floor((ms - (now - {WINDOW_MS})) / {WINDOW_MS / SLOTS}::DOUBLE) AS BIGINT), {SLOTS - 1}) AS bucket, seq, 's' || (k % 20) AS source, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL ELSE mag END AS lag
  FROM a, n WHERE type = 'error' AND ms >= now - {WINDOW_MS} AND ms <= now),
r AS (SELECT bucket, source, min(seq) AS s, count(*) AS n, max(lag) AS high FROM t GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY s) AS k FROM r)
SELECT bucket, CASE WHEN k <= 10 THEN source ELSE '{OVER}' END AS source, CAST(sum(n) AS BIGINT) AS n, round(max(high), 4) AS high FROM o GROUP BY 1, 2""")
def stalls_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    placed = grid.now_grid(e.filter("type = 'error'").withColumn("lag", _lag()).withColumn("source", F.concat(F.lit("s"), (F.col("k") % 20).cast("string"))), "ms", _now(e), WINDOW_MS, SLOTS)
    table = histogram.bounded_histogram(placed, "source", ["seq"], 10, {"n": (F.count("*"), "sum"), "high": (F.max(numbers.when_finite(F.col("lag"))), "max")}, ["bucket"])
    return table.withColumn("high", _r(F.col("high")))


@query(f"""{_NOW}, s AS (SELECT CAST(floor(ms / {WINDOW_MS / SLOTS}::DOUBLE) AS BIGINT) AS slot, sum(CASE WHEN k > 0 THEN k ELSE 1 END) AS w FROM a GROUP BY 1),
t AS (SELECT CAST(floor((slot * {WINDOW_MS // SLOTS} - (now - {WINDOW_MS})) / {WINDOW_MS / SLOTS}::DOUBLE) AS BIGINT) AS bucket, w, now FROM s, n)
SELECT least(bucket, {SLOTS - 1}) AS bucket, CAST(now - {WINDOW_MS} + least(bucket, {SLOTS - 1}) * {WINDOW_MS // SLOTS} AS BIGINT) AS bucket_start,
       CAST(now - {WINDOW_MS} + (least(bucket, {SLOTS - 1}) + 1) * {WINDOW_MS // SLOTS} AS BIGINT) AS bucket_end, CAST(sum(w) AS BIGINT) AS n FROM t WHERE bucket >= 0 GROUP BY 1, 2, 3""")
def rolling_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return grid.epoch_slots(e, "ms", _now(e), F.col("k"), WINDOW_MS, SLOTS)


# pages and retention


@query("! SELECT seq, ms, type FROM a WHERE type = 'error' ORDER BY seq DESC LIMIT 100")
def newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.newest(events(spark, sf_dir).filter("type = 'error'").select("seq", "ms", "type"), "seq", retention.page_limit(None))


@query("! SELECT seq, ms, type FROM a WHERE type = 'error' ORDER BY seq DESC LIMIT 200 OFFSET 300")
def newest_n_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.newest(events(spark, sf_dir).filter("type = 'error'").select("seq", "ms", "type"), "seq", retention.page_limit(500), 300)


@query("! SELECT seq, ms FROM a ORDER BY seq DESC LIMIT 2500")
def retention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.within_count(events(spark, sf_dir).select("seq", "ms"), "seq", 2500)


_OLD = "e AS (SELECT seq, CASE WHEN k % 23 > 0 THEN ms END AS ms FROM a), n AS (SELECT max(ms) AS now FROM e), y AS (SELECT seq, e.ms FROM e, n WHERE e.ms IS NULL OR e.ms >= now - 604800000)"


def _undated(e: DataFrame) -> DataFrame:
    return e.select("seq", F.when(F.col("k") % 23 > 0, F.col("ms")).alias("ms"))


@query(f"{_OLD} SELECT * FROM y")
def retention_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _undated(events(spark, sf_dir))
    return retention.within_age(e, "ms", latest(e), 604_800_000)


@query(f"{_OLD} SELECT * FROM y ORDER BY seq DESC LIMIT 900")
def retention_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _undated(events(spark, sf_dir))
    return retention.retained(e, "seq", "ms", latest(e), 900, 604_800_000)


@query("""b AS (SELECT count(*) AS before FROM a), r AS (SELECT count(*) AS after FROM a WHERE ms >= (SELECT max(ms) FROM a) - 604800000)
SELECT CAST(before AS BIGINT) AS before, CAST(least(after, 900) AS BIGINT) AS after, CAST(before - least(after, 900) AS BIGINT) AS pruned, before > least(after, 900) AS rewrote FROM b, r""")
def prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store says of a prune of three parts."""
    e = events(spark, sf_dir).select("seq", "ms")
    store = scratch_store(spark)
    for i in range(3):
        store.append(e.filter(F.col("seq") % 3 == i).select("seq", F.to_json(F.struct(F.col("ms").alias("receivedAt"))).alias("value")))
    report = store.prune(e.agg(F.max("ms")).first()[0], 900, 604_800_000)
    return spark.createDataFrame([tuple(report.values())], "before long, after long, pruned long, rewrote boolean")


# admission

TTL = 6 * 3_600_000
_FOLD = f"""o AS (SELECT seq, ms, "user", row_number() OVER (PARTITION BY "user" ORDER BY ms, seq) AS r FROM a),
f AS (SELECT seq, ms, "user", r, ms + {TTL} AS until, TRUE AS accepted FROM o WHERE r = 1
  UNION ALL SELECT o.seq, o.ms, o."user", o.r, CASE WHEN o.ms >= f.until THEN o.ms + {TTL} ELSE f.until END, o.ms >= f.until FROM f JOIN o ON o."user" = f."user" AND o.r = f.r + 1)"""


@query(f'{_FOLD} SELECT seq, "user", accepted FROM f')
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.accepted_arrivals(events(spark, sf_dir), "user", "ms", "seq", TTL).select("seq", "user", "accepted")


@query("s AS (SELECT \"user\" AS key, max(ms) + 600000 AS until FROM a WHERE seq % 50 = 0 GROUP BY 1) SELECT seq, ms FROM a WHERE seq % 50 <> 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.key = a.\"user\" AND s.until > a.ms)")
def unseen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    entries = e.filter("seq % 50 = 0").groupBy(F.col("user").alias("key")).agg((F.max("ms") + 600_000).alias("expires_at"))
    return repeats.unseen(e.filter("seq % 50 <> 0"), entries, "user", "ms").select("seq", "ms")


@query("q AS (SELECT seq // 20 AS batch, bool_and(k > 2 AND mag >= 0) AS ok, count(*) AS n FROM a GROUP BY 1) SELECT a.seq, q.batch FROM a JOIN q ON a.seq // 20 = q.batch WHERE q.ok")
def batch_all_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the batches in which all are valid."""
    e = events(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 20))
    verdicts = e.groupBy("batch").agg(F.coalesce(F.bool_and((F.col("k") > 2) & (F.col("mag") >= 0)), F.lit(True)).alias("ok"))
    return e.join(verdicts.filter("ok"), "batch", "left_semi").select("seq", "batch")


@query("""! SELECT seq, CASE WHEN k % 29 = 0 THEN 401 WHEN k % 23 = 0 THEN 404 WHEN schema_version NOT IN (9, 10, 11) THEN 415 WHEN mag * 40 > 3000 THEN 413 WHEN k % 13 = 0 THEN 400
  WHEN k % 11 = 0 THEN 422 WHEN k % 7 = 0 THEN 503 ELSE 202 END AS status FROM a""")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status for each request: the first gate that refuses it."""
    from pulsefold.plans.ingest import first_status

    k = F.col("k")
    gates = {401: k % 29 == 0, 404: k % 23 == 0, 415: ~F.col("schema_version").isin(9, 10, 11), 413: F.col("mag") * 40 > 3000, 400: k % 13 == 0, 422: k % 11 == 0, 503: k % 7 == 0}
    return events(spark, sf_dir).select("seq", first_status(gates).alias("status"))


@query("""! SELECT max(ms) AS last_accepted_at, max(ms) + 5000 - max(ms) AS last_accepted_age_ms, max(ms) >= (SELECT min(ms) FROM a) AS accepted_since_boot,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST(schema_version AS VARCHAR) AS v FROM a WHERE schema_version <> 11)) AS mismatched FROM a""")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    versions = F.filter(F.sort_array(F.collect_set(F.col("schema_version").cast("string"))), lambda v: ~v.isin("11", OVER))
    return e.agg(F.max("ms").alias("last_accepted_at"), (F.max("ms") + 5000 - F.max("ms")).alias("last_accepted_age_ms"), (F.max("ms") >= F.min("ms")).alias("accepted_since_boot"), F.array_join(versions, ",").alias("mismatched"))


@query("""! SELECT 'type' AS axis, type AS key, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 2 UNION ALL SELECT 'runtime', runtime, CAST(count(*) AS BIGINT) FROM a GROUP BY 2
UNION ALL SELECT 'schemaVersion', CAST(schema_version AS VARCHAR), CAST(count(*) AS BIGINT) FROM a GROUP BY 2 UNION ALL SELECT 'total', 'all', CAST(count(*) AS BIGINT) FROM a""")
def summary_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several axes of one pass over the events: each grouping set is an axis."""
    e = events(spark, sf_dir).select("type", "runtime", F.col("schema_version").cast("string").alias("version"))
    sets = e.groupingSets([[F.col("type")], [F.col("runtime")], [F.col("version")], []], F.col("type"), F.col("runtime"), F.col("version")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "runtime").when(F.col("g") == 6, "schemaVersion").otherwise("total")
    key = F.when(F.col("g") == 3, F.col("type")).when(F.col("g") == 5, F.col("runtime")).when(F.col("g") == 6, F.col("version")).otherwise(F.lit("all"))
    return sets.select(axis.alias("axis"), key.alias("key"), "n")
