"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens with false-discovery control.

Each long token is taken as a string over the alphabet of the encoding it seems to have. Three tests ask if it
could be uniformly random: chi-squared over equal bins of the alphabet, Wald-Wolfowitz runs above and below the
middle, and the lag-1 serial correlation. The least of the three p-values, corrected for their number, is the
token's. It is uniform for random tokens and very small for ordinary text, the smaller the longer a token is.

A token of MIN_BITS is a secret if its p-value is above a bound, LEAST_P or a higher one. Which one is told by the p-values in its class of
encoding and length: from those above some level follows how many random tokens there are at most (Storey's estimate,
raised by a standard error, by two for small classes), and the share of the tokens above the bound that they don't explain, the share of false alarms, must not
exceed RATE. A class of fewer than OWN such tokens says little about itself, so small classes are taken together: a class's share is
blended, by numbers of tokens, with that of the small classes of its encoding, that one with all small classes', and that with a prior by which
what no test can tell from random is random. So a lone secret is found whatever else a corpus holds, and a class in which many ordinary
tokens look random gets a higher bound or none, and hides no other's secrets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import starts_of, text_of

#: Kinds of the fixed patterns in their order, and the patterns.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that the tests look at.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Encodings, tried in this order: name, pattern, alphabet.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", r"^[0-9]+\z", _DIGITS),
    ("hex", r"^[0-9a-f]+\z", _DIGITS + "abcdef"),
    ("hex-upper", r"^[0-9A-F]+\z", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+\z", "234567" + _UPPER),
    ("base62", r"^[0-9A-Za-z]+\z", _DIGITS + _LOWER + _UPPER),
    ("base64", r"^[0-9A-Za-z+/]+\z", _DIGITS + _LOWER + _UPPER + "+/"),
    ("base64url", "", _DIGITS + _LOWER + _UPPER + "-_+/"),
)
#: Information that a secret carries at least, the share of false alarms, and the least p-value of a secret.
MIN_BITS, RATE, LEAST_P = 96.0, 0.05, 1e-3
#: Levels of p above which tokens are counted to estimate the random ones, as bins.
LEVELS = (2, 6, 14, 26)
#: Tokens above LEAST_P from which on a class is judged by itself, those by which a smaller one leans on the others, and those by which all lean on the prior.
OWN, LEAN, PRIOR = 50, 50.0, 20.0
#: Bins of -log10(p): their number per decade and in all; classes of length are powers of two up to this one.
PER_DECADE, BINS, LENGTH_CLASSES = 20, 400, 12

_SPAN = "struct<kind:string,start:int,end:int>"


def _found(df: DataFrame, text: Column, kind: str, pattern: str, could: Column) -> DataFrame:
    """`df` with __m_<kind>, all matches, and __s_<kind>, their starts. `could` is a cheap test that every text with a match passes."""
    none = F.array().cast("array<string>")
    df = df.withColumn(f"__m_{kind}", F.when(could, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    return df.withColumn(f"__s_{kind}", starts_of(text, pattern, F.col(f"__m_{kind}")))


def _spans(kind: str) -> Column:
    return F.zip_with(f"__m_{kind}", f"__s_{kind}", lambda m, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end")))


def _ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The spans by start, then by the order of the kinds."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(token: Column) -> Column:
    """struct<n, class, bin, bits> of a token; its p-value is Sidak's over the three tests."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    which = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        which = F.when(token.rlike(pattern), F.lit(i)).otherwise(which)
    one = F.transform(F.array(F.struct(chars.alias("chars"), which.alias("e"))), lambda x: F.struct(x["chars"].alias("chars"), x["e"].alias("e"), F.get(F.array(*[F.lit(a) for *_, a in ENCODINGS]), x["e"]).alias("alphabet")))
    one = F.transform(
        one,
        lambda x: F.struct(
            x["e"].alias("e"),
            F.size(x["chars"]).alias("n"),
            F.length(x["alphabet"]).alias("k"),
            F.transform(x["chars"], lambda c: F.position(c, x["alphabet"]) - 1).alias("codes"),
        ),
    )
    one = F.transform(
        one,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("e", "n", "k", "codes")],
            F.greatest(F.lit(2), F.least(x["k"], F.floor(x["n"] / 5).cast("int"))).alias("bins"),
            F.aggregate(x["codes"], F.lit(0), lambda s, c: s + F.when(c * 2 >= x["k"], 1).otherwise(0)).alias("high"),
        ),
    )

    def measured(x: Column) -> Column:
        n, k, bins, high = (x[c].cast("double") for c in ("n", "k", "bins", "high"))
        low = n - high
        # the bins hold k/bins codes each, as nearly as whole codes allow; the expected counts follow the exact widths
        first = lambda j: F.ceil(j * x["k"] / x["bins"])
        width = lambda j: (first(j + 1) - first(j)).cast("double")
        # sorted bins are counted in one fold
        placed = F.array_sort(F.transform(x["codes"], lambda c: F.floor(c * x["bins"] / x["k"]).cast("int")))
        squares = F.aggregate(
            placed,
            F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s")),
            lambda s, j: F.when(s["at"] == j, F.struct(s["at"].alias("at"), (s["c"] + 1).alias("c"), s["s"].alias("s"))).otherwise(
                F.struct(j.alias("at"), F.lit(1.0).alias("c"), (s["s"] + s["c"] * s["c"] / width(s["at"])).alias("s"))
            ),
            lambda s: s["s"] + s["c"] * s["c"] / width(s["at"]),
        )
        chi = squares * k / n - n
        pairs = F.zip_with(F.slice(x["codes"], F.lit(1), x["n"] - 1), F.slice(x["codes"], F.lit(2), x["n"] - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when((p["a"] * 2 >= x["k"]) != (p["b"] * 2 >= x["k"]), 1.0).otherwise(0.0))
        mean = (k - 1) / 2
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean)) / ((k * k - 1) / 12) / F.sqrt(n - 1)
        expected = 1 + 2 * high * low / n
        variance = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        return F.struct(x["e"].alias("e"), x["n"].alias("n"), x["k"].alias("k"), chi.alias("chi"), (bins - 1).alias("free"), F.when(variance > 0, (runs - expected) / F.sqrt(variance)).otherwise(F.lit(9.0)).alias("runs"), serial.alias("serial"))

    def judged(x: Column) -> Column:
        spread = 2 / (9 * x["free"])
        cube = (F.pow(F.greatest(x["chi"], F.lit(0.0)) / x["free"], F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        least = F.least(_upper_tail(cube), 2 * _upper_tail(F.abs(x["runs"])), 2 * _upper_tail(F.abs(x["serial"])))
        p = -F.expm1(3 * F.log1p(-F.least(least, F.lit(1 - 1e-12))))
        return F.struct(
            x["n"].alias("n"),
            (x["e"] * (LENGTH_CLASSES + 1) + F.least(F.lit(LENGTH_CLASSES), F.floor(F.log2(x["n"])).cast("int"))).alias("class"),
            F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30))) * PER_DECADE).cast("int")).alias("bin"),
            (x["n"] * F.log2(x["k"])).alias("bits"),
        )

    return F.get(F.transform(F.transform(one, measured), judged), F.lit(0))


def tokens(df: DataFrame, text_column: str = "text") -> DataFrame:
    """`df` with __tokens array<struct<start, end, n, class, bin, bits>>: the long tokens and their tests."""
    text = text_of(text_column)
    df = _found(df, text, "random", TOKEN, text.rlike(TOKEN))
    joined = F.zip_with("__m_random", "__s_random", lambda m, s: F.struct(m.alias("m"), s.alias("s"), _battery(m).alias("b")))
    tested = F.transform(joined, lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), *[x["b"][c].alias(c) for c in ("n", "class", "bin", "bits")]))
    return df.withColumn("__tokens", tested).drop("__m_random", "__s_random")


def _random(counts: dict[int, int], upto: int, errors: float) -> float:
    """Of tokens by bin, how many up to bin `upto` are random at most, by the uniform p-values of random ones and so many standard errors."""
    most = math.inf
    for level in LEVELS:
        below = 10 ** (-level / PER_DECADE)
        sure = sum(n for b, n in counts.items() if b < level)
        most = min(most, (sure + below + errors * math.sqrt((sure + 1) * below)) / (1 - below))
    return most * (1 - 10 ** (-(upto + 1) / PER_DECADE))


def bounds(counts: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, int]:
    """For each class of encoding and length in `counts` (tokens by class and bin) the bin up to which tokens are secrets; classes without one are left out."""
    last = round(-math.log10(LEAST_P) * PER_DECADE) - 1
    classes: dict[int, dict[int, int]] = {}
    for (c, b), n in counts.items():
        classes.setdefault(c, {})[b] = n
    small = {c for c, own in classes.items() if sum(n for b, n in own.items() if b <= last) < OWN}
    encodings: dict[int, dict[int, int]] = {}
    every: dict[int, int] = {}
    for c in small:
        group = encodings.setdefault(c // (LENGTH_CLASSES + 1), {})
        for b, n in classes[c].items():
            group[b] = group.get(b, 0) + n
            every[b] = every.get(b, 0) + n

    def blended(own: dict[int, int], upto: int, lean: float, other: float) -> float:
        """The share of random tokens up to a bin; 1 of none."""
        total = sum(n for b, n in own.items() if b <= upto)
        return (min(total, _random(own, upto, 2.0 if lean else 1.0)) + lean * other) / (total + lean) if total + lean else 1.0

    out = {}
    for c, own in classes.items():
        for upto in range(last, -1, -1):
            if c in small:
                encoding = blended(encodings[c // (LENGTH_CLASSES + 1)], upto, LEAN, blended(every, upto, PRIOR, 1.0))
                share = blended(own, upto, LEAN, encoding)
            else:
                share = blended(own, upto, 0.0, 1.0)
            if 1 - share <= rate:
                out[c] = upto
                break
    return out


def alarm_bins(df: DataFrame, rate: float = RATE) -> dict[int, int]:
    """`bounds` of the tokens of `df`, the outcome of `tokens`.

    A count for each class and bin goes to the driver: BINS + 1 for each pair of an encoding and a class of length, at most.
    """
    counts = df.select(F.explode("__tokens").alias("t")).groupBy(F.col("t.class").alias("class"), F.col("t.bin").alias("bin")).agg(F.count("*").alias("n")).collect()
    return bounds({(r["class"], r["bin"]): r["n"] for r in counts}, rate)


def scan(df: DataFrame, text_column: str = "text", rate: float = RATE, min_bits: float = MIN_BITS) -> DataFrame:
    """`df` with base_spans and spans, array<struct<kind, start, end>> in code points, end exclusive.

    base_spans: leftmost non-overlapping matches per kind, `assign` with a value of ASSIGN_LENGTH characters at
    least. spans: these, and kind `random` for the tokens that the tests take as secrets, which may lie in a base
    span. Both are ordered by start, then kind.

    A null text counts as empty and has no spans; texts are scanned whole. Repeated rows get equal spans. An
    empty table gives an empty one. Input columns with the names of the new ones are replaced.
    """
    df = df.drop(*[c for c in df.columns if c in ("base_spans", "spans") and c != text_column])
    text = text_of(text_column)
    bins = alarm_bins(tokens(df.select(text_column), text_column), rate)
    could = {"assign": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike(HEX)}
    out = df
    for kind, pattern in zip(BASE_KINDS, (ASSIGN, ACCESS, HEX), strict=True):
        out = _found(out, text, kind, pattern, could[kind])
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    assigned = F.zip_with("__m_assign", "__s_assign", lambda m, s: F.struct(F.lit("assign").alias("kind"), s.alias("start"), F.when(value(m) >= ASSIGN_LENGTH, s + F.length(m)).alias("end")))
    assigned = F.filter(assigned, lambda s: s["end"].isNotNull())
    out = out.withColumn("base_spans", _ordered(F.concat(assigned, _spans("access"), _spans("hex")), BASE_KINDS))
    out = tokens(out, text_column)
    upto = F.create_map(*[F.lit(x) for c, b in bins.items() for x in (c, b)]) if bins else F.create_map().cast("map<int,int>")
    random = F.filter("__tokens", lambda t: (t["bits"] >= min_bits) & (t["bin"] <= F.coalesce(F.try_element_at(upto, t["class"]), F.lit(-1))))
    added = F.transform(random, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    out = out.withColumn("spans", _ordered(F.concat("base_spans", added), (*BASE_KINDS, "random")))
    return out.drop("__tokens", *[f"__{x}_{k}" for k in BASE_KINDS for x in "ms"])


#: Characters of a piece in which spans are replaced.
PIECE = 4096


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by `mark`. `spans` are ordered by start.

    The text is cut into pieces first, so that the work does not grow with its length for each span.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def clean(piece: Column, i: Column) -> Column:
        first = i * PIECE
        inside = F.filter(spans, lambda x: (x["start"] < first + PIECE) & (x["end"] > first))
        state = F.aggregate(
            inside,
            F.struct(F.lit("").alias("done"), first.alias("at")),
            lambda s, x: F.struct(
                F.when(x["start"] >= s["at"], F.concat(s["done"], F.substring(piece, s["at"] - first + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["done"]).alias("done"),
                F.greatest(s["at"], x["end"]).alias("at"),
            ),
            lambda s: F.concat(s["done"], F.substring(piece, s["at"] - first + 1, F.lit(PIECE))),
        )
        return F.when(F.size(inside) > 0, state).otherwise(piece)

    return F.when(F.size(spans) > 0, F.array_join(F.transform(pieces, clean), "")).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
