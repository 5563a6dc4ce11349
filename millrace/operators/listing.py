"""Listings: search, order, pages and their envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numbers, text


def search(rows: DataFrame, column: str, what: str | None, case_sensitive: bool = False) -> DataFrame:
    """Rows whose column contains ``what``; all rows for an empty search."""
    if not what:
        return rows
    return rows.filter(F.contains(F.col(column), F.lit(what)) if case_sensitive else text.contains_ci(F.col(column), what))


def ordered(rows: DataFrame, sort: str | None, order: str | None, by_name: str, by_time: str, key: str) -> DataFrame:
    """By name if asked for, else by time; ascending only for ``asc``; the key breaks ties."""
    column = by_name if sort == "name" else by_time
    return rows.orderBy(F.col(column).asc_nulls_last() if order == "asc" else F.col(column).desc_nulls_last(), key)


def page(rows: DataFrame, number: int = 1, limit: int = 10) -> DataFrame:
    if number < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    return rows.offset((number - 1) * limit).limit(limit)


def envelope(rows: DataFrame, number: int = 1, limit: int = 10) -> DataFrame:
    """One row: total, page, limit, total_pages; right also for a page past the end."""
    if number < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    total = rows.agg(F.count("*").alias("total"))
    return total.select("total", F.lit(number).alias("page"), F.lit(limit).alias("page_limit"), numbers.pages(F.col("total"), limit).alias("total_pages"))


def point(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def newest(rows: DataFrame, by: str, key: str, size: int = 200) -> DataFrame:
    """The last ``size`` rows by time."""
    return rows.orderBy(F.col(by).desc(), F.col(key).desc()).limit(size)


def target_first(rows: DataFrame, target: Column, line: str, within: str) -> DataFrame:
    """``rank``: target rows of each group first, the rest in order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(target.desc(), line)))


def gated_union(must: DataFrame, optional: DataFrame, skipped: DataFrame, include_optional: bool, include_skipped: bool) -> DataFrame:
    """The categories asked for, each row with its ``category``."""
    out = must.withColumn("category", F.lit("must"))
    if include_optional:
        out = out.unionByName(optional.withColumn("category", F.lit("optional")))
    if include_skipped:
        out = out.unionByName(skipped.withColumn("category", F.lit("skipped")))
    return out


def ranked(sources: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """The rows of several sources one after the other, each ordered by a column, ascending or not; ``source_rank`` tells which."""
    out = None
    for k, (source, by, ascending) in enumerate(sources):
        # One ascending sort over all: of each source the other direction's key is null.
        keys = (F.col(by) if ascending else F.lit(None).cast(source.schema[by].dataType), F.lit(None).cast(source.schema[by].dataType) if ascending else F.col(by))
        one = source.select("*", F.lit(k).alias("source_rank"), keys[0].alias("_up"), keys[1].alias("_down"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("source_rank", "_up", F.col("_down").desc()).drop("_up", "_down")
