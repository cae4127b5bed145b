"""Reading VARIANT values without coercion: what a JSON value is, and its content if it is that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def parse_strict(text: Column) -> Column:
    """The JSON value of a text, null if anything but white space stands around one value."""
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]"))), "$", "array<variant>")
    return F.when(F.size(wrapped) == 2, F.get(wrapped, F.lit(0)))


def field(v: Column, name: str) -> Column:
    """A member as VARIANT; null if absent (a JSON null is a VARIANT of its own)."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, pattern: str) -> Column:
    return F.coalesce(kind(v).rlike(pattern), F.lit(False))


def is_object(v: Column) -> Column:
    """True for an object; its members are not looked into, as they are for its schema."""
    return F.try_variant_get(v, "$", "struct<__none variant>").isNotNull()


def is_array(v: Column) -> Column:
    return elements(v).isNotNull()


def is_text(v: Column) -> Column:
    return _is(v, "^STRING$")


def is_number(v: Column) -> Column:
    return _is(v, _NUMBER)


def number(v: Column) -> Column:
    """The number, null for anything else."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    """The string, null for anything else."""
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def boolean(v: Column) -> Column:
    return F.when(_is(v, "^BOOLEAN$"), F.try_variant_get(v, "$", "boolean"))


def elements(v: Column) -> Column:
    """The elements of an array as VARIANT, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def fields(v: Column, names: tuple[str, ...]) -> Column:
    """Some members of an object as a struct of VARIANT, found in one pass; null for anything else."""
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'`{n}` variant' for n in names)}>")


def members(v: Column) -> Column:
    """The names of an object's members."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def absent(v: Column) -> Column:
    """True for a member that is not there or is a JSON null."""
    return v.isNull() | (kind(v) == "VOID")
