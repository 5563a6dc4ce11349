"""Connected components of a table of links, by joins: smallest labels spread and labels of labels are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components", first: str = "x", second: str = "y") -> DataFrame:
    """(id, label) of every end of ``links``: label is the smallest id reachable. Empty links give an empty table.

    Every round takes the smallest label among a node and its neighbours and then the label of that label, so paths
    halve; tables in the shared folder cut the lineage. Only a count of changed rows comes to the driver.
    """
    both = links.select(F.col(first).alias("a"), F.col(second).alias("b")).union(links.select(F.col(second), F.col(first))).distinct()
    edges = scratch.table(f"{name}-edges", both)
    labels = scratch.table(f"{name}-0", edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        moved = best.join(up, "low", "left").select("id", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("old")).alias("changed"))
        after = scratch.table(f"{name}-{step}", moved)
        scratch.drop(f"{name}-{step - 1}")
        if after.filter("changed").isEmpty():
            return after.select("id", "label")
        labels = after.select("id", "label")
