"""Casts that never throw: what doesn't fit becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


def cast_type(c: Column, kind: T.DataType, target: str) -> Column:
    """``target`` is int64, float64, datetime, str, string, bool or category.

    int64 rounds half to even, with and without nulls. Texts other than the
    false words are true. Null stays null in a cast to text.
    """
    is_text = isinstance(kind, T.StringType)
    number = text.to_double(c) if is_text else c.try_cast("double")
    if target in ("int64", "int", "integer", "int32"):
        return c.cast("long") if isinstance(kind, T.IntegralType) else F.bround(number, 0).try_cast("long")
    if target in ("float64", "float", "double"):
        return number
    if target in ("datetime", "datetime64", "date"):
        return text.parse_datetime(c) if is_text else c.try_cast("timestamp_ntz")
    if target in ("str", "string", "category"):
        return c.cast("string")
    if target in ("bool", "boolean"):
        if isinstance(kind, T.BooleanType):
            return c
        if is_text:
            return F.when(c.isin("False", "false", "0"), False).when(c.isNotNull(), True)
        return c.cast("double") != 0
    raise ValueError(f"unknown target type {target!r}")


def cast_revenue(c: Column) -> Column:
    """The oldest cleaner's revenue: a number, or null."""
    return c.try_cast("double")
