"""The `events` table seen as telemetry: the same columns in Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The upper boundaries of a server's latency buckets, in milliseconds (fixed values).
BOUNDARIES = (50, 100, 250, 500, 1000, 2500, 5000, 10000)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ms, type, mag, k, op, runtime, app_version, schema_version, user of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.col("event_type").alias("type"),
        F.col("value").alias("mag"),
        k.alias("k"),
        F.concat(F.lit("op-"), k.cast("string")).alias("op"),
        F.element_at(F.array(*map(F.lit, ("main", "renderer", "server", "bogus"))), (F.col("user_id") % 4 + 1).cast("int")).alias("runtime"),
        F.concat(F.lit("0.1."), F.col("user_id").cast("string")).alias("app_version"),
        (5 + F.col("event_id") % 7).alias("schema_version"),
        F.col("user_id").alias("user"),
    )


def latest(df: DataFrame) -> Column:
    """The injected clock: the last instant of the events."""
    return df.agg(F.max("ms")).scalar()


SQL = """a AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type AS type, value AS mag, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         'op-' || CAST(json_extract(props, '$.k') AS INTEGER) AS op,
         CASE user_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'renderer' WHEN 2 THEN 'server' ELSE 'bogus' END AS runtime,
         '0.1.' || user_id AS app_version, 5 + event_id % 7 AS schema_version, user_id AS "user"
  FROM events)"""
