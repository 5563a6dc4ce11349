"""Operators on ordered rows. Those that need an order are prefix scans, so a group of any size is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scans import Greatest, Latest, Next, Total, scan


def intervals(rows: DataFrame, group: str, start: str, last: Column, tie: str | None = None, limit: int | None = None) -> DataFrame:
    """``interval_end``: one before the next start of the group; ``last`` for the last row."""
    found = scan(rows, group, [c for c in (start, tie) if c], limit=limit, _next=Next(F.struct(F.col(start).alias("v"))))
    return found.withColumn("interval_end", F.coalesce(F.col("_next.v") - 1, last)).drop("_next")


def segments(rows: DataFrame, group: str, by: list[str], starts: Column, limit: int | None = None) -> DataFrame:
    """``segment``: how many starting rows the group has had, this one included."""
    return scan(rows, group, by, limit=limit, segment=Total(F.when(starts, 1).otherwise(0)))


def running(rows: DataFrame, group: str, by: list[str], change: Column, limit: int | None = None) -> DataFrame:
    return scan(rows, group, by, limit=limit, balance=Total(change))


def first_closed(rows: DataFrame, group: str, by: str, limit: int | None = None) -> DataFrame:
    """For each group the first place where a balance that has been above zero is zero or less; null if none."""
    opened = scan(rows, group, [by], limit=limit, _opened=Greatest(F.when(F.col("balance") > 0, 1).otherwise(0)))
    return opened.groupBy(group).agg(F.min(F.when((F.col("_opened") == 1) & (F.col("balance") <= 0), F.col(by))).alias("closed_at"))


def ahead(rows: DataFrame, group: str, by: list[str], what: Column, size: int = 5, limit: int | None = None) -> DataFrame:
    """``seen_ahead``: whether one of the next rows fulfils ``what``: whether the next that does is at most ``size`` rows away."""
    placed = scan(rows, group, by, limit=limit, _row=Total(F.lit(1)))
    found = scan(placed, group, by, limit=limit, _next=Next(F.when(what, F.col("_row"))))
    return found.withColumn("seen_ahead", F.coalesce(F.col("_next") - F.col("_row") <= size, F.lit(False))).drop("_row", "_next")


def nearest_before(rows: DataFrame, group: str, by: list[str], value: Column, limit: int | None = None) -> DataFrame:
    """``nearest``: the last value that isn't null up to this row."""
    return scan(rows, group, by, limit=limit, nearest=Latest(value))


def last_marker(rows: DataFrame, group: str, place: str, marker: Column) -> DataFrame:
    """The last place of a marker in each group, or -1."""
    return rows.groupBy(group).agg(F.coalesce(F.max(F.when(marker, F.col(place))), F.lit(-1)).alias("last_place"))


def debounced(rows: DataFrame, group: str, by: str, gap_seconds: float, limit: int | None = None) -> DataFrame:
    """The rows that no other row of the group follows within the gap: the trailing edge of a debounce."""
    found = scan(rows, group, [by], limit=limit, _next=Next(F.col(by)))
    wait = (F.unix_micros("_next") - F.unix_micros(F.col(by))) / 1e6
    return found.withColumn("_wait", wait).filter(F.col("_wait").isNull() | (F.col("_wait") > gap_seconds)).drop("_wait", "_next")


def chunks(rows: DataFrame, size: str, chunk: int) -> DataFrame:
    """One row for each read of ``chunk`` units: offset, length and whether it is the last. Empty rows give one empty read."""
    top = F.greatest(F.col(size) - 1, F.lit(0))
    out = rows.withColumn("chunk_offset", F.explode(F.sequence(F.lit(0).cast("long"), top.cast("long"), F.lit(chunk).cast("long"))))
    length = F.greatest(F.least(F.lit(chunk).cast("long"), F.col(size) - F.col("chunk_offset")), F.lit(0).cast("long"))
    return out.withColumn("chunk_length", length).withColumn("eof", F.col("chunk_offset") + F.col("chunk_length") >= F.col(size))
