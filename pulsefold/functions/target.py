"""Request targets as columns: path and query parameters, as a URL parser reads them against http://localhost."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Schemes whose addresses have a host, and segments that mean this folder or the one above (fixed values).
HOSTED = ("http", "https", "ws", "wss", "ftp")
HERE, ABOVE = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
#: Characters that no host has, once its escapes are decoded.
_NO_HOST = r"[\x00-\x20\x7F#/:<>?@\[\\\]^|%]"


def decoded(text: Column, plus: bool = True) -> Column:
    """Escapes decoded as UTF-8; what is no escape stays. With `plus`, a plus is a space."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe if plus else F.replace(safe, F.lit("+"), F.lit("%2B")))


def _named_host(authority: Column) -> Column:
    """True if the part between the slashes and the path names a host and, if any, a port."""
    place = F.regexp_replace(authority, "^.*@", "")
    port = F.regexp_extract(place, r":(\d*)\z", 1)
    host = F.regexp_replace(place, r":\d*\z", "")
    six = host.rlike(r"^\[[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\]\z")
    plain = decoded(host, plus=False)
    labels = F.split(F.regexp_replace(plain, r"\.\z", ""), r"\.")
    numeric = plain.rlike(r"(^|\.)\d+\.?\z")
    last = F.try_to_number(F.element_at(labels, -1), F.lit("9999999999"))
    four = (F.size(labels) <= 4) & F.forall(F.slice(labels, 1, F.size(labels) - 1), lambda x: x.rlike(r"^\d+\z") & (F.coalesce(F.try_to_number(x, F.lit("999")), F.lit(256)) <= 255)) & F.coalesce(last.cast("double") < F.pow(F.lit(256.0), 5 - F.size(labels)), F.lit(False))
    named = (F.length(plain) > 0) & ~plain.rlike(_NO_HOST) & (~numeric | four)
    return (six | F.coalesce(named, F.lit(False))) & (F.coalesce(F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999")), F.lit(0)) <= 65535) & (F.length(port) <= 5)


def _resolved(path: Column) -> Column:
    """The path with a slash in front and without segments that mean this folder or the one above."""
    segments = F.split(F.regexp_replace(path, r"^/", ""), "/")

    def step(s: Column, x: Column) -> Column:
        low = F.lower(x)
        up, stay = low.isin(*ABOVE), low.isin(*HERE)
        kept = F.when(up, F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))).when(stay, s["out"]).otherwise(F.array_append(s["out"], x))
        return F.struct(kept.alias("out"), (up | stay).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))
    # a path that ends in such a segment ends in a slash
    return F.aggregate(segments, start, step, lambda s: F.concat(F.lit("/"), F.array_join(s["out"], "/"), F.when(s["open"] & (F.size(s["out"]) > 0), "/").otherwise("")))


def parts(target: Column) -> Column:
    """struct<path string, query array<struct<name, value>>> of a request target; null if it can't be read.

    Outer white space goes, backslashes are slashes, and a fragment counts nowhere. Two slashes begin a host, which has to be one; a target
    with a scheme is taken for its path. Parameters are decoded and stand in their order.
    """
    text = F.regexp_replace(F.regexp_replace(target, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    text = F.regexp_replace(text, r"(?s)#.*\z", "")
    before = F.replace(F.regexp_extract(text, r"(?s)^([^?]*)", 1), F.lit("\\"), F.lit("/"))
    query = F.regexp_extract(text, r"(?s)^[^?]*\?(.*)\z", 1)
    scheme = F.lower(F.regexp_extract(before, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    rest = F.regexp_replace(before, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    own = scheme == "http"
    hosted = F.when(scheme == "", before.rlike("^//")).when(own, rest.rlike("^//")).otherwise(scheme.isin(*HOSTED) | rest.rlike("^//"))
    authority = F.regexp_extract(rest, "^/*([^/]*)", 1)
    path = F.when(hosted, F.regexp_replace(rest, "^/*[^/]*", "")).otherwise(rest)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    split = F.transform(pairs, lambda x: F.struct(decoded(F.regexp_extract(x, r"(?s)^([^=]*)", 1)).alias("name"), decoded(F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1)).alias("value")))
    readable = ~hosted | ((~scheme.isin("", *HOSTED)) | _named_host(authority))
    return F.when(target.isNotNull() & F.coalesce(readable, F.lit(False)), F.struct(_resolved(path).alias("path"), split.alias("query")))


def parameters(spark: SparkSession, target: str) -> tuple[str, dict[str, str]] | None:
    """(path, parameters) of one request target; of a repeated parameter the first value counts. None if it can't be read."""
    row = spark.createDataFrame([(target,)], "target string").select(parts(F.col("target")).alias("p")).first()["p"]
    if row is None:
        return None
    out: dict[str, str] = {}
    for pair in row["query"]:
        out.setdefault(pair["name"], pair["value"])
    return row["path"], out
