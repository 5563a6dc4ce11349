"""Series for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring(total: Column, completed: Column, passed: Column) -> Column:
    """STRUCT<passed, not_passed, not_run>."""
    return F.struct(passed.alias("passed"), (completed - passed).alias("not_passed"), (total - completed).alias("not_run"))


def radar(values: Column, dimensions: int = 6) -> Column:
    """The vector, or zeros where it is empty or null."""
    return F.when(values.isNull() | (F.size(values) == 0), F.array_repeat(F.lit(0.0), dimensions)).otherwise(values)


def trend(rows: DataFrame, day: Column, failed: Column, passed: Column) -> DataFrame:
    return rows.groupBy(day.alias("day")).agg(F.count_if(failed).alias("failed"), F.count_if(passed).alias("passed")).orderBy("day")


def parallel(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Records as parallel arrays, for a chart's few points."""
    points = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("p")
    return rows.agg(points).select(*[F.transform("p", lambda x, c=None: x).getField(c).alias(c) for c in columns])


def ordered_status_counts(rows: DataFrame, status: str) -> DataFrame:
    """passed, failed (with ignored), pending, total."""
    n = lambda *s: F.count_if(F.col(status).isin(*s))
    return rows.agg(n("passed").alias("passed"), n("failed", "ignored").alias("failed"), n("pending").alias("pending"), F.count("*").alias("total"))


def outcome_totals(rows: DataFrame) -> DataFrame:
    """Batch counters from (cancelled, generated, executed, compiled, failed): a cancelled task only counts as completed."""
    live = ~F.col("cancelled")
    return rows.agg(
        F.count_if(live & F.col("executed") & F.col("compiled") & (F.col("failed") == 0)).alias("success"),
        F.count_if(live & F.col("executed") & F.col("compiled") & (F.col("failed") > 0)).alias("failed"),
        F.count_if(live & F.col("executed") & ~F.col("compiled")).alias("compile_error"),
        F.count_if(live & F.col("generated")).alias("generated"),
        F.count_if(live & F.col("executed")).alias("executed"),
        F.count("*").alias("completed"),
    )
