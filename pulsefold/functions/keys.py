"""Keys of the summary: failure signatures, release order, effective instants, bounded labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite

#: Longest key of a histogram, in characters.
KEY_LENGTH = 128
#: Names that the retired generator made.
GENERATED_NAME = r"^(chat-[a-z0-9]{6}|split-[a-z0-9]{8}|shell-[a-z0-9]{6})\z"
#: Names of operations, culprits and features.
PLAIN_NAME = r"^[a-z0-9][a-z0-9-]{0,63}\z"


def filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def bounded_key(text: Column) -> Column:
    return F.substring(text, 1, KEY_LENGTH)


def plain(number: Column) -> Column:
    """A finite number as text with six decimals at most, whole numbers without any; null otherwise."""
    return F.regexp_replace(F.when(finite(number), number).cast("decimal(36,6)").cast("string"), r"\.?0+\z", "")


def frame_place(function: Column, file: Column, line: Column) -> Column:
    """`file:line (function)` of a stack frame with whatever of the three is there; null without any."""
    place = F.concat(F.coalesce(filled(file), F.lit("")), F.coalesce(F.concat(F.lit(":"), plain(line)), F.lit("")))
    return filled(F.concat_ws(" ", filled(place), F.concat(F.lit("("), filled(function), F.lit(")"))))


def signature(type_: Column, name: Column, place: Column, reason: Column, exit_code: Column, source: Column) -> Column:
    """What identifies a failure: an error's name and first frame, a crash's reason and exit code, a stall's source."""
    return (
        F.when(type_ == "error", F.concat(filled(name), F.coalesce(F.concat(F.lit(" @ "), place), F.lit(""))))
        .when(type_ == "crash", F.concat(F.lit("crash:"), filled(reason), F.coalesce(F.concat(F.lit(":exit="), plain(exit_code)), F.lit(""))))
        .when(type_ == "performance-stall", F.concat(F.lit("stall:"), filled(source)))
    )


def release_order(version: Column) -> Column:
    """An array that orders dotted numeric versions part by part; null for any other label.

    Leading zeros don't count and missing parts are 0: trailing zero parts go, and each part compares by its
    number of digits, then by the digits.
    """
    stripped = F.regexp_replace(version, r"(\.0+)+\z", "")
    parts = F.transform(F.split(stripped, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))
    ordered = F.transform(parts, lambda p: F.struct(F.length(p).alias("digits"), p.alias("number")))
    return F.when(version.rlike(r"^\d+(\.\d+)*\z"), ordered)


def effective_instant(received: Column, received_present: Column, timestamp: Column) -> Column:
    """The receiver's clock if the event has one, else the sender's; null unless that number is finite."""
    chosen = F.when(received_present, received).otherwise(timestamp)
    return F.when(finite(chosen), chosen)
