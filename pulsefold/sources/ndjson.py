"""The event log as newline-delimited JSON, and as a table of typed columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.functions import variant as V
from pulsefold.functions.keys import effective_instant, filled, frame_place, signature

from .ledger import Files


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of the log, a file or a folder of them; a log that is not there is empty."""
    try:
        return spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def ordered_lines(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(seq, value): the lines of the log, numbered from `first` by the order of the files' paths, then of the lines.

    A line's number is its place in its block of a file and the lines of all blocks before, so it is the same however many tasks
    read the files. The counts of the blocks go to the driver, which plans a task for each of them anyway.
    """
    lines = read_lines(spark, path)
    if not lines.inputFiles():
        return lines.select(F.lit(0).cast("long").alias("seq"), "value")
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    placed = lines.select("value", *where, F.monotonically_increasing_id().alias("place"))
    blocks = placed.groupBy("path", "block").agg(F.min("place").alias("least"), F.count("*").alias("n")).collect()
    shifts, before = [], first
    for b in sorted(blocks, key=lambda b: (b["path"], b["block"])):
        shifts.append((b["path"], b["block"], before - b["least"]))
        before += b["n"]
    shift = spark.createDataFrame(shifts, "path string, block long, shift long")
    return placed.join(shift, ["path", "block"]).select((F.col("place") + F.col("shift")).alias("seq"), "value")


def parsed(lines: DataFrame, order: Column | None = None) -> DataFrame:
    """(seq, value, event): blank lines are left out; event is null where a line is not one JSON value.

    Without an `order` the lines are numbered as they are read, which keeps the order of one file's lines.
    """
    text = F.regexp_replace("value", r"^[\s﻿]+|[\s﻿]+\z", "")
    seq = F.monotonically_increasing_id() if order is None else order
    return lines.withColumn("seq", seq).select("seq", text.alias("value")).filter(F.length("value") > 0).withColumn("event", V.parse_strict(F.col("value")))


def unreadable(log: DataFrame) -> DataFrame:
    """(total, unreadable): lines that hold a JSON value, and those that don't."""
    return log.agg(F.count("event").alias("total"), F.count_if(F.col("event").isNull()).alias("unreadable"))


def typed(log: DataFrame) -> DataFrame:
    """One row per readable value: seq, event and the columns that the filters and axes read.

    Values that are not objects or arrays are left out, as every filter does. Columns are null where a
    member is absent or of another kind.
    """
    e = F.col("event")
    names = ("type", "runtime", "platform", "appVersion", "schemaVersion", "receivedAt", "timestamp", "name", "frames", "reason", "exitCode", "source", "lagMs")
    # members first, then their values: each is looked up once
    # a filter would be pushed below the parsing, whose text would be parsed once more for it; rows made of a list are not
    kept = log.select("seq", F.explode(F.filter(F.array(e), lambda x: V.is_object(x) | V.is_array(x))).alias("event"))
    found = kept.select("seq", "event", *[V.field(e, n).alias(f"__{n}") for n in names])
    found = found.withColumn("__frame", F.get(V.elements(F.col("__frames")), F.lit(0)))
    texts = {n: V.text(F.col(f"__{n}")) for n in ("type", "runtime", "platform", "appVersion", "name", "reason", "source")}
    texts |= {n: V.text(V.field(F.col("__frame"), n)) for n in ("function", "file")}
    numbers = {n: V.number(F.col(f"__{n}")) for n in ("schemaVersion", "receivedAt", "timestamp", "exitCode", "lagMs")} | {"line": V.number(V.field(F.col("__frame"), "line"))}
    valued = found.select(
        "seq",
        "event",
        *[x.alias(f"t_{n}") for n, x in texts.items()],
        *[x.alias(f"n_{n}") for n, x in numbers.items()],
        (~V.absent(F.col("__receivedAt"))).alias("received"),
        F.when(~V.absent(F.col("__schemaVersion")), F.coalesce(V.text(F.col("__schemaVersion")), F.to_json("__schemaVersion"))).alias("shown"),
    )
    t, n = (lambda x: F.col(f"t_{x}")), (lambda x: F.col(f"n_{x}"))
    whole = F.when(n("schemaVersion") == F.floor(n("schemaVersion")), n("schemaVersion").cast("long").cast("string"))
    return valued.select(
        "seq",
        "event",
        t("type").alias("type"),
        t("runtime").alias("runtime"),
        t("platform").alias("platform"),
        t("appVersion").alias("app_version"),
        F.coalesce(whole, F.col("shown")).alias("schema_version"),
        n("schemaVersion").alias("schema_number"),
        effective_instant(n("receivedAt"), F.col("received"), n("timestamp")).alias("instant"),
        filled(signature(t("type"), t("name"), frame_place(t("function"), t("file"), n("line")), t("reason"), n("exitCode"), t("source"))).alias("signature"),
        filled(t("name")).alias("error_name"),
        filled(t("reason")).alias("reason"),
        filled(t("source")).alias("source"),
        n("lagMs").alias("lag"),
    )


def filtered(events: DataFrame, type: str | None = None, since: float | None = None, platform: str | None = None, app_version: str | None = None, signature: str | None = None) -> DataFrame:
    """The events that meet all filters given; an empty text or a `since` that is not finite filters nothing."""
    for column, value in (("type", type), ("platform", platform), ("app_version", app_version), ("signature", signature)):
        if value:
            events = events.filter(F.col(column) == value)
    if since is not None and abs(since) < float("inf"):
        events = events.filter(F.col("instant") >= since)
    return events


def write_lines(log: DataFrame, path: str) -> None:
    """Append the events to the log, one JSON text per line, in the order of their `seq`.

    Each append is a folder of its own below `path`, and its files have ranges of `seq`, so `ordered_lines` reads the log in order.
    """
    spark = log.sparkSession
    number = sum(n.startswith("append-") for n in Files(spark, path).listed(""))
    events = log.filter(F.col("event").isNotNull()).select("seq", F.to_json("event").alias("value"))
    events.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(f"{path}/append-{number:012d}")
