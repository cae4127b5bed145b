"""Numbers: finiteness, integrality, and the parsing of query parameters."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for a number that is neither NaN nor infinite; false for null. Spark orders NaN above infinity."""
    return F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))


def when_finite(x: Column) -> Column:
    """The number, or null if it is not finite."""
    return F.when(finite(x), x)


def integral(x: Column) -> Column:
    """True for a finite number without a fraction; 1.0 counts."""
    return finite(x) & (x.cast("double") == F.floor(x.cast("double")))


def half_up(x: Column) -> Column:
    """The nearest integer, halves upwards."""
    return F.floor(x + 0.5).cast("long")


_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|Infinity)\Z")
_RADIX = {"0x": 16, "0o": 8, "0b": 2}


def parameter_number(text: str | None) -> float:
    """A query parameter as a number: blank is 0; hexadecimal, octal, binary and exponents are read; else NaN."""
    if text is None:
        return math.nan
    text = text.strip()
    if not text:
        return 0.0
    if text[:2].lower() in _RADIX:
        try:
            return float(int(text[2:], _RADIX[text[:2].lower()])) if re.fullmatch(r"[0-9a-fA-F]+", text[2:]) else math.nan
        except ValueError:
            return math.nan
    return float(text.replace("Infinity", "inf")) if _NUMBER.match(text) else math.nan


def retention_setting(text: str | None, fallback: int) -> float:
    """A retention bound from the environment: unset, blank, malformed or negative gives the fallback, 0 switches it off."""
    if text is None or not text.strip():
        return fallback
    value = parameter_number(text)
    if not math.isfinite(value) or value < 0:
        return fallback
    return int(value) if value == int(value) else value
