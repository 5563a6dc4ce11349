"""Trees as rows of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators.scans import Total, scan


def nodes(files: DataFrame, path: str = "path") -> DataFrame:
    """Every prefix of every path, once: path, parent, name, depth, is_file (whether it is one of the given paths)."""
    every = files.select(F.explode(paths.prefixes(F.col(path))).alias("path"), F.col(path).alias("_full"))
    found = every.groupBy("path").agg(F.max(F.col("path") == F.col("_full")).alias("is_file"))
    p = F.col("path")
    return found.select("path", paths.dirname(p).alias("parent"), paths.basename(p).alias("name"), paths.depth(p).alias("depth"), "is_file")


def name_order(name: str = "name", collation: str | None = None) -> list[Column]:
    """Sort keys of names: ``lower(name)``, or a collation such as UNICODE (the root locale: accents and case matter last) or a language's; equal ones by their bytes."""
    return [F.lower(name) if collation is None else F.collate(F.col(name), collation), F.col(name)]


def children(tree: DataFrame, parent: str, collation: str | None = None) -> DataFrame:
    """One level, directories first, then by name without regard to case, or as the collation has it."""
    return tree.filter(F.col("parent") == parent).orderBy("is_file", *name_order("name", collation))


def tree_order(tree: DataFrame, collation: str | None = None) -> DataFrame:
    return tree.orderBy("parent", "is_file", *name_order("name", collation))


def keep_matches(tree: DataFrame, keyword: str | None) -> DataFrame:
    """Nodes whose name contains the keyword, and their ancestors; a matching directory doesn't keep its children."""
    if not keyword or not keyword.strip():
        return tree
    hits = tree.filter(F.contains(F.lower("name"), F.lit(keyword.strip().lower())))
    wanted = hits.select(F.explode(paths.prefixes(F.col("path"))).alias("path")).distinct()
    return tree.join(wanted, "path", "left_semi")


def cap_depth(tree: DataFrame, levels: int = 5) -> DataFrame:
    return tree.filter(F.col("depth") < levels)


def first_leaf(tree: DataFrame, root: Column) -> DataFrame:
    """The first file of each root in path order."""
    return tree.filter("is_file").groupBy(root.alias("root")).agg(F.min("path").alias("first_path"))


def readme(tree: DataFrame) -> DataFrame:
    return tree.filter((F.col("parent") == "") & (F.lower("name") == "readme.md"))


def refresh(tree: DataFrame, parent: str, fresh: DataFrame) -> DataFrame:
    """The tree with one directory's children replaced; subtrees of children that stay are kept."""
    names = fresh.select(F.col("path").alias("_path"))
    below = F.startswith(F.col("path"), F.lit(f"{parent}/" if parent else ""))
    child = F.when(F.lit(bool(parent)), F.concat(F.lit(f"{parent}/"), paths.first_segment(F.expr(f"substr(path, {len(parent) + 2})")))).otherwise(paths.first_segment(F.col("path")))
    others = tree.filter(~below)
    deeper = tree.filter(below & (F.col("parent") != parent)).withColumn("_child", child).join(names, F.col("_child") == F.col("_path"), "left_semi").drop("_child")
    return others.unionByName(deeper).unionByName(fresh)


def flatten(symbols: DataFrame, group: str, name: str, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Nested symbols in order with ``indent``: how many symbols of the group enclose each.

    A symbol is enclosed by those that start before it (or with it and end later) and end at or after its end. Symbols nest properly, so
    those still open are the starts less the ends up to here: one running sum over starts and ends instead of pairs of symbols.
    """
    opens = symbols.select(group, name, start, end, F.lit(1).alias("_step"), F.col(start).alias("_at"), (-F.col(end)).alias("_tie"))
    closes = symbols.select(group, name, start, end, F.lit(-1).alias("_step"), F.col(end).alias("_at"), F.col(start).alias("_tie"))
    both = opens.unionByName(closes).withColumn("_closes", -F.col("_step"))
    found = scan(both, group, ["_at", "_closes", "_tie", name], limit=limit, _open=Total(F.col("_step"), own=False)).filter("_step = 1")
    return found.select(group, name, start, end, F.coalesce("_open", F.lit(0)).cast("int").alias("indent")).orderBy(group, start, F.col(end).desc())
