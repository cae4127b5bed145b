"""Schemas of flat tables from text, before there is a session that could read DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType, "boolean": T.BooleanType, "variant": T.VariantType}


def struct_of(text: str) -> T.StructType:
    """The schema of `name type, ...`."""
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in (c.split() for c in text.split(","))])
