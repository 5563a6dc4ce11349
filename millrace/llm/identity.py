"""Row identity: rows are told apart though their ids are null or repeated."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import Scratch

ROW = "_row"


def identified(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart.

    That is ``id_col`` where no id is null or repeated. Else the rows are stored once with a number of their own, as a number that is
    worked out anew in each job may differ between jobs.
    """
    odd = docs.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col(id_col).isNull() | (F.col("n") > 1))
    if odd.isEmpty():
        return docs, id_col
    return scratch.table("identified", docs.withColumn(ROW, F.monotonically_increasing_id())), ROW


@contextmanager
def fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that start inside split the same files alike, however many executors there are, so numbers by partition are the same in each of their jobs."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
