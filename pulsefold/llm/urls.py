"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes and confirmed by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import small_or_plain

#: The rules of the query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Verdict for a URL that no rule fits.
DEFAULT = "allow"
#: Hex digits of the short hash prefix.
PREFIX = 8


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(df: DataFrame, rules: DataFrame, url_column: str = "url", default: str = DEFAULT) -> DataFrame:
    """`df` with host, path, rule and verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest rule
    (host and path together) wins, and of equally long ones block. Each distinct pair of host and path is
    expanded to the label suffixes and path prefixes whose lengths occur in the rules; an expression meets a
    rule if the first hex digits of both SHA-256 digests agree, and counts if the whole digests do.

    A null URL or one without `://` has an empty host and path and gets the default. Repeated rules count
    once, rules with a null host or path never fit. Empty tables on either side are allowed. Input columns
    with the names of the new ones are replaced. Very long URLs are read whole: only as many suffixes and
    prefixes are made as the rules have lengths.
    """
    df = df.drop(*[c for c in df.columns if c in ("host", "path", "rule", "verdict") and c != url_column])
    url = F.coalesce(F.col(url_column), F.lit(""))
    parts = df.withColumn("__host", host_of(url)).withColumn("__path", path_of(url))
    text = F.concat("host", "path")
    table = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("rule_verdict"))  # "block" sorts after "allow"
        .select(text.alias("rule"), "rule_verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), F.sha2(text, 256).alias("digest"))
    )
    lengths = table.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars")).first()
    distinct = parts.select(F.col("__host").alias("h"), F.col("__path").alias("p")).distinct()
    have = F.size(F.split("h", r"\."))
    # one expression, however many lengths the rules have; they are no more than the longest rule is long
    listed = lambda c: F.array(*map(F.lit, lengths[c])).cast("array<int>")
    host = lambda n: F.call_function("substring_index", F.col("h"), F.lit("."), -n)
    made = F.transform(
        F.filter(listed("labels"), lambda n: n <= have),
        lambda n: F.transform(F.filter(listed("chars"), lambda m: m <= F.length("p")), lambda m: F.concat(host(n), F.substring(F.col("p"), F.lit(1), m))),
    )
    made = F.explode(F.array_distinct(F.flatten(made)))
    asked = distinct.select("h", "p", made.alias("e")).withColumn("__digest", F.sha2("e", 256)).withColumn("prefix", F.substring("__digest", 1, PREFIX))
    known = small_or_plain(table.withColumn("prefix", F.substring("digest", 1, PREFIX)).drop("labels", "chars"))
    met = asked.join(known, "prefix").filter(F.col("__digest") == F.col("digest"))
    best = met.groupBy("h", "p").agg(F.max(F.struct(F.length("rule").alias("n"), "rule_verdict", "rule")).alias("best"))
    out = parts.join(best, (F.col("__host") == F.col("h")) & (F.col("__path") == F.col("p")), "left")
    if url_column in ("host", "path", "rule", "verdict"):
        out = out.drop(url_column)
    return out.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("best.rule"), "verdict": F.coalesce("best.rule_verdict", F.lit(default))}).drop("__host", "__path", "h", "p", "best")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT x.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY x.page_id ORDER BY length(r.host || r.path) DESC, r.verdict DESC, r.host || r.path DESC) AS k
  FROM x JOIN r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path))
SELECT x.page_id, x.host, x.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM x LEFT JOIN m ON x.page_id = m.page_id AND m.k = 1
"""
