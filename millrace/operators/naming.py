"""Names to show for projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths


def display_names(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name): the given name; else the only visible directory; else the first C file's directory, or its stem at the root;
    else the last part of the id. ``projects``: id, given; ``files``: id, path."""
    nested, top = F.contains("path", F.lit("/")), paths.first_segment(F.col("path"))
    visible = files.filter(nested & ~F.startswith("path", F.lit("."))).select("id", top.alias("dir")).distinct()
    only = visible.groupBy("id").agg(F.min("dir").alias("dir"), F.count("*").alias("n")).filter("n = 1").drop("n")
    c = files.filter(F.endswith(F.lower("path"), F.lit(".c"))).groupBy("id").agg(F.min("path").alias("path"))
    source = c.select("id", F.when(F.contains("path", F.lit("/")), paths.first_segment(F.col("path"))).otherwise(paths.stem(F.col("path"))).alias("source"))
    out = projects.join(only, "id", "left").join(source, "id", "left")
    return out.select("id", F.coalesce(F.nullif("given", F.lit("")), "dir", "source", F.substring_index("id", "_", -1)).alias("name"))
