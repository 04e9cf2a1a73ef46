"""Dynamic JSON values: tests and access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """A variant; null where the text is no JSON."""
    return F.try_parse_json(text)


def kind(v: Column) -> Column:
    """VOID, BOOLEAN, BIGINT, DOUBLE, STRING, ARRAY<...> or OBJECT<...>."""
    return F.schema_of_variant(v)


def is_null(v: Column) -> Column:
    return F.is_variant_null(v)


def is_boolean(v: Column) -> Column:
    return kind(v) == "BOOLEAN"


def is_integer(v: Column) -> Column:
    return kind(v) == "BIGINT"


def is_float(v: Column) -> Column:
    return kind(v).rlike("^(DOUBLE|FLOAT|DECIMAL)")


def is_number(v: Column) -> Column:
    return is_integer(v) | is_float(v)


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def is_array(v: Column) -> Column:
    return kind(v).startswith("ARRAY")


def is_dict(v: Column) -> Column:
    return kind(v).startswith("OBJECT")


def get(v: Column, path: str, type_: str) -> Column:
    return F.try_variant_get(v, path, type_)
