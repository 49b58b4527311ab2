"""Scalar helpers: null-safe arithmetic, text normalisation, dates, finite numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient, truncated; NULL for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NULL for a zero divisor."""
    return a % F.nullif(b, F.lit(0))


def full_match(column: Column, pattern: str) -> Column:
    """The whole text matches, not a part of it."""
    return column.rlike(f"^(?:{pattern})$")


def finite(column: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(column) | column.isin(float("inf"), float("-inf")), None).otherwise(column)


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def weekday_from_sunday(column: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(column) - 1


def words_only(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def ordered_list(values: Column, order: Column, separator: str = ",") -> Column:
    """An aggregate: texts joined in a given order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)
