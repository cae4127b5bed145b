"""The summary of a log: its axes as small tables over one typed scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefold.functions import variant as V
from pulsefold.functions.keys import GENERATED_NAME, bounded_key, filled, release_order
from pulsefold.functions.numbers import finite, half_up, integral, when_finite
from pulsefold.functions.validation import INTRODUCED, RUNTIMES
from pulsefold.operators import grid
from pulsefold.operators.histogram import OVERFLOW, bounded_histogram, bucket_percentiles, top_k

#: Caps of the axes (fixed values).
AXIS_CAP, OPERATION_CAP, FEATURE_CAP, RELEASE_CAP, NAME_CAP, SCALE_CAP, TOP = 10, 129, 64, 64, 200, 4, 10


def _is_rollup(events: DataFrame) -> bool:
    return "weight" in events.columns


def _n(events: DataFrame) -> Column:
    """How many events the rows stand for: of a rollup, the sum of their weights."""
    return F.coalesce(F.sum("weight"), F.lit(0)) if _is_rollup(events) else F.count("*")


def _first_last(events: DataFrame) -> tuple[Column, Column]:
    return (F.min("low_instant"), F.max("high_instant")) if _is_rollup(events) else (F.min("instant"), F.max("instant"))


def by_type(events: DataFrame) -> DataFrame:
    """(type, n) for every known type."""
    counts = events.groupBy("type").agg(_n(events).alias("n"))
    return events.sparkSession.createDataFrame([(t,) for t in INTRODUCED], "type string").join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def axis(events: DataFrame, column: str, cap: int = AXIS_CAP) -> DataFrame:
    """(column, n): a bounded histogram of non-empty texts."""
    return bounded_histogram(events.withColumn(column, bounded_key(filled(F.col(column)))), column, ["seq"], cap, {"n": (_n(events), "sum")})


def schema_versions(events: DataFrame) -> DataFrame:
    """(schema_version, n): all versions; there is no cap, and nothing is ranked or broadcast."""
    return events.withColumn("schema_version", bounded_key(filled(F.col("schema_version")))).filter("schema_version IS NOT NULL").groupBy("schema_version").agg(_n(events).alias("n"))


def crash_reasons(events: DataFrame) -> DataFrame:
    return axis(events.filter("type = 'crash'"), "reason")


def top_error_names(events: DataFrame) -> DataFrame:
    names = events.filter("type = 'error' AND error_name IS NOT NULL").withColumn("name", bounded_key(F.col("error_name")))
    return top_k(names, ["name"], TOP, _n(events))


def top_signatures(events: DataFrame) -> DataFrame:
    return top_k(events.withColumn("signature", bounded_key(F.col("signature"))), ["signature", "type"], TOP, _n(events))


def seen(events: DataFrame) -> DataFrame:
    first, last = _first_last(events)
    return events.agg(first.alias("first_seen"), last.alias("last_seen"))


def _stats(events: DataFrame) -> dict[str, tuple[Column, str]]:
    if _is_rollup(events):
        return {"n": (_n(events), "sum"), "low": (F.min("lag_low"), "min"), "high": (F.max("lag_high"), "max"), "total": (F.sum("lag_total"), "sum"), "usable": (F.coalesce(F.sum("lag_n"), F.lit(0)), "sum")}
    v = when_finite(F.col("lag"))
    return {"n": (F.count("*"), "sum"), "low": (F.min(v), "min"), "high": (F.max(v), "max"), "total": (F.sum(v), "sum"), "usable": (F.count(v), "sum")}


def _with_mean(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.when(F.col("usable") > 0, F.col("total") / F.col("usable")).otherwise(F.lit(0.0))).drop("total", "usable")


def stalls(events: DataFrame) -> DataFrame:
    """(n, low, high, mean) of all stalls; a lag that is not finite counts as a stall alone."""
    return _with_mean(events.filter("type = 'performance-stall'").agg(*[a.alias(k) for k, (a, _) in _stats(events).items()]))


def stalls_by_source(events: DataFrame) -> DataFrame:
    own = events.filter("type = 'performance-stall'").withColumn("source", bounded_key(F.col("source")))
    return _with_mean(bounded_histogram(own, "source", ["seq"], AXIS_CAP, _stats(events)))


def operation_rows(events: DataFrame) -> DataFrame:
    """(seq, pos, name, n, ok, fail, low, high, mean, boundaries, buckets): the usable entries of the windows."""
    each = events.filter("type = 'operational-metrics'").select("seq", V.field(F.col("event"), "boundaries").alias("b"), F.posexplode(V.elements(V.field(F.col("event"), "operations"))).alias("pos", "o"))
    at = lambda name: V.field(F.col("o"), name)
    n = V.number(at("count"))
    rows = each.filter(V.is_object(F.col("o"))).select(
        "seq",
        "pos",
        bounded_key(filled(V.text(at("operation")))).alias("name"),
        n.alias("n"),
        *[F.coalesce(when_finite(V.number(at(k))), F.lit(0.0)).alias(c) for k, c in (("okCount", "ok"), ("failCount", "fail"))],
        *[when_finite(V.number(at(k))).alias(c) for k, c in (("min", "low"), ("max", "high"), ("avg", "mean"))],
        F.transform(V.elements(F.col("b")), V.number).alias("boundaries"),
        F.transform(V.elements(at("buckets")), V.number).alias("buckets"),
    )
    return rows.filter(F.col("name").isNotNull() & finite(F.col("n")) & (F.col("n") >= 0))


def _capped_names(rows: DataFrame, cap: int) -> DataFrame:
    """The rows with their name or, beyond the names seen first, the shared one."""
    first = rows.groupBy("name").agg(F.min(F.struct("seq", "pos")).alias("__first")).orderBy("__first").limit(cap).select("name", F.lit(True).alias("__own"))
    return rows.join(F.broadcast(first), "name", "left").withColumn("name", F.when(F.col("__own"), F.col("name")).otherwise(F.lit(OVERFLOW))).drop("__own")  # broadcast: `cap` rows


def operations(events: DataFrame) -> DataFrame:
    """(name, n, ok, fail, low, high, mean): the mean weighs entries by count, entries without any give no extremes."""
    rows = _capped_names(operation_rows(events), OPERATION_CAP)
    some = F.col("n") > 0
    out = rows.groupBy("name").agg(
        F.sum("n").alias("n"),
        F.sum("ok").alias("ok"),
        F.sum("fail").alias("fail"),
        F.min(F.when(some, F.col("low"))).alias("low"),
        F.max(F.when(some, F.col("high"))).alias("high"),
        F.sum(F.col("mean") * F.col("n")).alias("__total"),
        F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).alias("__weight"),
    )
    return out.withColumn("mean", F.when(F.col("__weight") > 0, F.col("__total") / F.col("__weight")).otherwise(F.lit(0.0))).drop("__total", "__weight")


def operation_latency(events: DataFrame) -> DataFrame:
    """(name, n, excluded, boundaries, buckets, p50, p95, p99): histograms of one scale added up, the fullest of the first scales reported.

    Histograms with other boundaries are never added; what they hold, and the scales beyond the cap, is `excluded`.
    """
    rows = _capped_names(operation_rows(events), OPERATION_CAP)
    names = rows.select("name").distinct()
    whole = F.forall("buckets", lambda x: F.coalesce(integral(x) & (x >= 0), F.lit(False))) & F.forall("boundaries", lambda x: F.coalesce(finite(x), F.lit(False)))
    usable = rows.filter(whole & (F.size("buckets") == F.size("boundaries") + 1)).withColumn("held", F.aggregate("buckets", F.lit(0.0), lambda s, x: s + x)).filter("held > 0")
    scales = usable.groupBy("name", "boundaries").agg(F.min(F.struct("seq", "pos")).alias("first"), F.sum("held").alias("held"))
    # the first scales of a name, by a ranking within the name: boundaries come from clients, so a name can have many
    rank = F.row_number().over(Window.partitionBy("name").orderBy("first"))
    kept = scales.withColumn("rank", rank).filter(F.col("rank") <= SCALE_CAP)
    best = kept.groupBy("name").agg(F.max_by(F.struct("boundaries", "held"), F.struct("held", -F.col("rank"))).alias("best"))
    everything = scales.groupBy("name").agg(F.sum("held").alias("everything"))
    chosen = best.join(everything, "name").select("name", "best.boundaries", F.col("best.held").alias("n"), (F.col("everything") - F.col("best.held")).alias("excluded"))
    sums = usable.join(chosen.select("name", "boundaries"), ["name", "boundaries"]).select("name", "boundaries", F.posexplode("buckets").alias("i", "x"))
    sums = sums.groupBy("name", "boundaries", "i").agg(F.sum("x").alias("x"))
    listed = sums.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("buckets"))  # as many as one scale has
    percentiles = bucket_percentiles(sums.withColumn("bound", F.get("boundaries", F.col("i"))), ["name"], "i", "x", "bound")
    both = names.join(chosen, "name", "left").join(listed, "name", "left").join(percentiles, "name", "left")
    return both.select("name", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("excluded", F.lit(0.0)).alias("excluded"), "boundaries", "buckets", "p50", "p95", "p99")


def workspace_shape(events: DataFrame) -> DataFrame:
    """(measure, windows, low, high, mean) of the six counts."""
    own = events.filter("type = 'workspace-shape'")
    each = own.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), V.number(V.field(F.col("event"), m)).alias("x")) for m in ("workspaces", "panesOpen", "panesActive", "chats", "peakPanesOpen", "peakChats")])).alias("m")).select("m.measure", F.when(finite(F.col("m.x")) & (F.col("m.x") >= 0), F.col("m.x")).alias("x"))
    return each.groupBy("measure").agg(F.count("x").alias("windows"), F.min("x").alias("low"), F.max("x").alias("high"), F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean"))


def workspace_shape_seen(events: DataFrame) -> DataFrame:
    """(windows_seen, last_snapshot_at) of all shape windows."""
    own = events.filter("type = 'workspace-shape'")
    return own.agg(F.count("*").alias("windows_seen"), F.max(when_finite(V.number(V.field(F.col("event"), "windowEndedAt")))).alias("last_snapshot_at"))


def workspace_names(events: DataFrame) -> DataFrame:
    """(name, windows): the windows that hold each name; a name counts once in a window."""
    own = events.filter("type = 'workspace-names'").select("seq", F.posexplode(V.elements(V.field(F.col("event"), "chats"))).alias("pos", "c")).select("seq", "pos", bounded_key(filled(V.text(F.col("c")))).alias("name"))
    once = own.filter("name IS NOT NULL").groupBy("seq", "name").agg(F.min("pos").alias("pos"))
    named = _capped_names(once, NAME_CAP)
    return named.groupBy("name", "seq").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("*").alias("windows"))


def generated_share(names: DataFrame) -> DataFrame:
    """(considered, generated, share) over the names of `workspace_names`."""
    own = names.filter(F.col("name") != OVERFLOW)
    return own.agg(F.count("*").alias("considered"), F.count_if(F.col("name").rlike(GENERATED_NAME)).alias("generated")).withColumn("share", F.try_divide("generated", "considered"))


def workspace_latest(events: DataFrame) -> DataFrame:
    """(max_chat_count, last_chat_count, truncated_ever, last_snapshot_at): the latest by the sender's clock, ties and windows without one by arrival."""
    e = F.col("event")
    own = events.filter("type = 'workspace-names'").select("seq", when_finite(V.number(V.field(e, "chatCount"))).alias("n"), when_finite(V.number(V.field(e, "windowEndedAt"))).alias("ended"), V.boolean(V.field(e, "truncated")).alias("cut"))
    ladder = F.struct(F.col("ended").isNotNull().alias("clocked"), F.col("ended"), F.col("seq"))
    return own.agg(F.max("n").alias("max_chat_count"), F.max_by("n", ladder).alias("last_chat_count"), F.coalesce(F.bool_or("cut"), F.lit(False)).alias("truncated_ever"), F.max("ended").alias("last_snapshot_at"))


def feature_usage(events: DataFrame) -> DataFrame:
    """(name, uses, windows); the shared name, too, counts a window once."""
    own = events.filter("type = 'feature-usage'").select("seq", F.posexplode(V.elements(V.field(F.col("event"), "features"))).alias("pos", "f"))
    rows = own.select("seq", "pos", bounded_key(filled(V.text(V.field(F.col("f"), "name")))).alias("name"), V.number(V.field(F.col("f"), "count")).alias("n"))
    named = _capped_names(rows.filter(F.col("name").isNotNull() & finite(F.col("n")) & (F.col("n") > 0)), FEATURE_CAP)
    return named.groupBy("name", "seq").agg(F.sum("n").alias("n")).groupBy("name").agg(F.sum("n").alias("uses"), F.count("*").alias("windows"))


def feature_usage_seen(events: DataFrame) -> DataFrame:
    """(distinct_count, last_window_at): the names of `feature_usage`, the shared one included, and the latest window's end."""
    own = events.filter("type = 'feature-usage'")
    last = own.agg(F.max(when_finite(V.number(V.field(F.col("event"), "windowEndedAt")))).alias("last_window_at"))
    return feature_usage(events).agg(F.count("*").alias("distinct_count")).crossJoin(last)  # each side is one row


def windows(events: DataFrame) -> DataFrame:
    """(type, windows, last_ended): the events of each type that has windows, and the latest end of one."""
    own = events.filter(F.col("type").isin("operational-metrics", "workspace-names", "workspace-shape", "feature-usage", "process-memory"))
    return own.groupBy("type").agg(F.count("*").alias("windows"), F.max(when_finite(V.number(V.field(F.col("event"), "windowEndedAt")))).alias("last_ended"))


def matched(events: DataFrame) -> DataFrame:
    """(n): how many events there are."""
    return events.agg(_n(events).alias("n"))


def generated_shaped(events: DataFrame) -> DataFrame:
    """(distinct_count, considered, generated, share) of the workspace names; the shared one is a name, but not considered."""
    names = workspace_names(events)
    return names.agg(F.count("*").alias("distinct_count")).crossJoin(generated_share(names))  # each side is one row


def process_memory(events: DataFrame) -> DataFrame:
    """(runtime, windows, samples, low, high, mean, heap, peak, latest) for each runtime; nulls without a report."""
    at = lambda name: V.number(V.field(F.col("event"), name))
    usable = lambda name: F.when(finite(at(name)) & (at(name) >= 0), at(name))
    own = events.filter("type = 'process-memory'").select("runtime", when_finite(at("windowEndedAt")).alias("ended"), *[usable(k).alias(c) for k, c in (("samples", "samples"), ("rssMinBytes", "low"), ("rssAvgBytes", "mid"), ("rssMaxBytes", "high"), ("heapUsedMaxBytes", "heap"), ("processAgeMs", "age"))])
    weighed = F.col("samples").isNotNull() & F.col("mid").isNotNull()
    by = own.groupBy("runtime").agg(
        F.count("*").alias("windows"),
        F.sum("samples").alias("samples"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        half_up(F.try_divide(F.sum(F.when(weighed, F.col("mid") * F.col("samples"))), F.sum(F.when(weighed, F.col("samples"))))).alias("mean"),
        F.max("heap").alias("heap"),
        F.max(F.when(F.col("high").isNotNull(), F.struct("high", "ended", "age"))).alias("peak"),
        F.max(F.when(F.col("ended").isNotNull(), F.struct("ended", "high", "age", "mid"))).alias("latest"),
    )
    dimension = events.sparkSession.createDataFrame([(r,) for r in RUNTIMES], "runtime string")
    return dimension.join(by, "runtime", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))


def operation_rejections(events: DataFrame) -> DataFrame:
    """(runtime, windows, with_rejections, rejected, stale, invalid, last_rejected_at); sums are null until a valid figure comes."""
    at = lambda name: V.number(V.field(F.col("event"), name))
    valid = lambda name: F.when(integral(at(name)) & (at(name) >= 0), at(name).cast("long"))
    own = events.filter("type = 'operational-metrics'").select("runtime", valid("rejected").alias("rejected"), valid("rejectedStale").alias("stale"), valid("rejectedInvalid").alias("invalid"), when_finite(at("windowEndedAt")).alias("ended"))
    by = own.groupBy("runtime").agg(F.count("*").alias("windows"), F.count_if(F.col("rejected") > 0).alias("with_rejections"), F.sum("rejected").alias("rejected"), F.sum("stale").alias("stale"), F.sum("invalid").alias("invalid"), F.max(F.when(F.col("rejected") > 0, F.col("ended"))).alias("last_rejected_at"))
    out = events.sparkSession.createDataFrame([(r,) for r in RUNTIMES], "runtime string").join(by, "runtime", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("windows", "with_rejections")})


def releases(events: DataFrame) -> DataFrame:
    own = events.withColumn("release", bounded_key(filled(F.col("app_version"))))
    first, last = _first_last(events)
    return bounded_histogram(own, "release", ["seq"], RELEASE_CAP, {"n": (_n(events), "sum"), "first_seen": (first, "min"), "last_seen": (last, "max")})


def newest_release(events: DataFrame) -> DataFrame:
    """(newest, distinct_count): the newest by numeric order over all labels, ties to the first seen."""
    labels = events.withColumn("label", filled(F.col("app_version"))).filter("label IS NOT NULL").groupBy("label").agg(F.min("seq").alias("s")).withColumn("o", release_order(F.col("label")))
    return labels.agg(F.max_by("label", F.when(F.col("o").isNotNull(), F.struct("o", -F.col("s")))).alias("newest"), F.count("*").alias("distinct_count"))


def type_reach(events: DataFrame) -> DataFrame:
    """(type, introduced, eligible, emitted, verdict). The events are counted by version first, so the join meets few rows."""
    dimension = events.sparkSession.createDataFrame(list(INTRODUCED.items()), "type string, introduced int")
    versions = events.filter(finite(F.col("schema_number"))).groupBy("schema_number").agg(_n(events).alias("n"))
    # broadcast: a row for each type
    eligible = versions.join(F.broadcast(dimension), F.col("schema_number") >= F.col("introduced")).groupBy("type").agg(F.sum("n").alias("eligible"))
    out = dimension.join(eligible, "type", "left").withColumn("eligible", F.coalesce("eligible", F.lit(0))).join(by_type(events).withColumnRenamed("n", "emitted"), "type")
    return out.withColumn("verdict", F.when(F.col("emitted") > 0, "emitting").when(F.col("eligible") > 0, "eligible-silent").otherwise("no-eligible-builds"))


def timeline(events: DataFrame, now_ms: int, window_ms: int = grid.WINDOW_MS, buckets: int = grid.BUCKETS) -> DataFrame:
    return grid.now_grid(events, "instant", F.lit(now_ms), window_ms, buckets).groupBy("bucket", "bucket_start", "bucket_end").agg(F.count("*").alias("n"))


def stalls_timeline(events: DataFrame, now_ms: int, window_ms: int = grid.WINDOW_MS, buckets: int = grid.BUCKETS) -> DataFrame:
    """(bucket, source, n, high): stalls by bucket and source."""
    placed = grid.now_grid(events.filter("type = 'performance-stall'"), "instant", F.lit(now_ms), window_ms, buckets)
    return bounded_histogram(placed, "source", ["seq"], AXIS_CAP, {"n": (F.count("*"), "sum"), "high": (F.max(when_finite(F.col("lag"))), "max")}, ["bucket"])


AXES = {
    "byType": by_type, "appVersions": lambda e: axis(e, "app_version"), "platforms": lambda e: axis(e, "platform"), "byRuntime": lambda e: axis(e, "runtime"), "schemaVersions": schema_versions,
    "crashReasons": crash_reasons, "topErrorNames": top_error_names, "topSignatures": top_signatures, "seen": seen, "stalls": stalls, "stallsBySource": stalls_by_source, "operations": operations, "operationLatency": operation_latency,
    "workspaceShape": workspace_shape, "workspaceShapeSeen": workspace_shape_seen, "workspaceNames": workspace_names, "generatedShaped": generated_shaped, "workspaceLatest": workspace_latest, "featureUsage": feature_usage, "featureUsageSeen": feature_usage_seen, "processMemory": process_memory, "operationRejections": operation_rejections,
    "releases": releases, "newestRelease": newest_release, "typeReach": type_reach, "windows": windows, "matched": matched,
}


#: Axes that read labels alone: a rollup gives them as well as the events do.
LABEL_AXES = ("byType", "appVersions", "platforms", "byRuntime", "schemaVersions", "crashReasons", "topErrorNames", "topSignatures", "seen", "stalls", "stallsBySource", "releases", "newestRelease", "typeReach", "matched")


def axes(events: DataFrame, now_ms: int, labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every axis by name. `labels`, a rollup of the same events, spares LABEL_AXES the events; timelines read the days they show."""
    tables = {name: make(labels if labels is not None and name in LABEL_AXES else events) for name, make in AXES.items()}
    recent = events.filter(F.col("day") >= (now_ms - grid.WINDOW_MS) // 86_400_000) if "day" in events.columns else events
    return tables | {"timeline": timeline(recent, now_ms), "stallsTimeline": stalls_timeline(recent, now_ms)}


def document(events: DataFrame, now_ms: int, labels: DataFrame | None = None) -> DataFrame:
    """(axis, rows): the axes of the events, each as a JSON list of its rows.

    Each axis reads `events` anew, so `events` should be a table of typed events and not the text of the log.
    The rows of an axis are bounded by its cap; those of schemaVersions by the versions that senders made up.
    """
    out = None
    for name, table in axes(events, now_ms, labels).items():
        part = table.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*table.columns)))).alias("rows")).select(F.lit(name).alias("axis"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
