"""Dates as text and numbers; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """Milliseconds and a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd HH:mm")


def epoch_or_zero(ts: Column) -> Column:
    return F.coalesce(F.unix_timestamp(ts.cast("timestamp")), F.lit(0))


def dated_id(prefix: str, ts: Column, token: Column) -> Column:
    """``prefix_yyyyMMdd_`` and the first eight characters of a token, such as a uuid."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(ts, "yyyyMMdd"), F.substring(token, 1, 8))
