"""Rates, percentages, sizes and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole; 1 where there is nothing to count."""
    return F.when(whole == 0, 1.0).otherwise(F.try_divide(part, whole))


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves up; 100 where there is nothing to count."""
    return F.when(whole == 0, 100).otherwise(F.floor(F.try_divide(part, whole) * 100 + 0.5)).cast("long")


def coverage_bucket(value: Column) -> Column:
    return F.when(value.isNull() | (value == 0), "none").when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low")


def progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), 10 + F.floor(F.try_divide(done, total) * 90)).cast("long")


def pages(total: Column, limit: int) -> Column:
    return F.ceil(total / limit).cast("long")


def size_unit(size: Column) -> tuple[Column, Column]:
    """The value in the largest fitting unit, not rounded, and the unit; null stays null."""
    unit = F.when(size < 1024, "B").when(size < 1024**2, "KB").when(size < 1024**3, "MB").otherwise("GB")
    value = F.when(size < 1024, size.cast("double")).when(size < 1024**2, size / 1024).when(size < 1024**3, size / 1024**2).otherwise(size / 1024**3)
    return value, F.when(size.isNotNull(), unit)


def human_size(size: Column) -> Column:
    value, unit = size_unit(size)
    return F.when(size.isNull(), "-").when(size < 1024, F.concat_ws(" ", size.cast("string"), F.lit("B"))).otherwise(F.concat_ws(" ", F.format_string("%.2f", value), unit))


def value_unit(value: Column, unit: str) -> Column:
    """A number with its unit; two dashes for null, one decimal for durations that aren't whole."""
    whole = value == F.floor(value)
    plain = F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))
    if unit == "%":
        shown = F.concat(plain, F.lit("%"))
    elif unit in ("小时/天", "天", "小时"):
        shown = F.concat_ws(" ", F.when(whole, plain).otherwise(F.format_string("%.1f", value)), F.lit(unit))
    else:
        shown = F.concat_ws(" ", plain, F.lit(unit))
    return F.when(value.isNull(), "- -").otherwise(shown)
