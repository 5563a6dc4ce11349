"""Bounded walks on call graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import Scratch


def call_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without operators and self calls."""
    return edges.filter(~F.startswith("dst", F.lit("<operator>")) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def within_hops(edges: DataFrame, start: Column, hops: int = 3) -> DataFrame:
    """Edges on paths of at most ``hops`` from the nodes that fulfil ``start``, down and up: (src, dst), once.

    Level by level: each level is a join of the frontier's distinct nodes with the edges, so cycles end with the bound and a
    node is expanded once a level however many paths lead to it.
    """
    clean = call_edges(edges)
    roots = clean.select(F.col("src").alias("node")).union(clean.select("dst")).distinct().filter(start)
    found = None
    for here, there in (("src", "dst"), ("dst", "src")):
        frontier = roots
        for _ in range(hops):
            level = clean.join(frontier.withColumnRenamed("node", here), here, "left_semi").select("src", "dst")
            found = level if found is None else found.union(level)
            frontier = level.select(F.col(there).alias("node")).distinct()
    return found.distinct()


def reached(edges: DataFrame, start: Column, hops: int, ways: tuple[str, ...] = ("down", "up")) -> DataFrame:
    """(way, node, depth): the nodes within ``hops`` of those that fulfil ``start``, with the least number of hops; roots have 0.

    The clean edges are stored once. Each level joins the frontier, the nodes that are new, with the edges and leaves out what the stored
    visited levels hold, so that every node is expanded once; it ends when no node is new, whatever ``hops`` allows.
    """
    scratch = Scratch(edges.sparkSession, "reached")
    clean = call_edges(edges)
    sides = {"down": F.struct(F.lit("down").alias("way"), F.col("src").alias("node"), F.col("dst").alias("next")), "up": F.struct(F.lit("up").alias("way"), F.col("dst").alias("node"), F.col("src").alias("next"))}
    # Both ways are one walk, over edges that know their way.
    steps = scratch.table("steps", clean.select(F.explode(F.array(*[sides[w] for w in ways])).alias("s")).select("s.*"))
    nodes = steps.select("node").union(steps.select("next")).distinct().filter(start)
    roots = nodes.select(F.explode(F.array(*[F.lit(w) for w in ways])).alias("way"), "node", F.lit(0).alias("depth"))
    visited = frontier = scratch.table("depth0", roots)
    for depth in range(1, hops + 1):
        near = steps.join(frontier.select("way", "node"), ["way", "node"], "left_semi").select("way", F.col("next").alias("node")).distinct()
        new = near.join(visited.select("way", "node"), ["way", "node"], "left_anti").select("way", "node", F.lit(depth).alias("depth"))
        frontier = scratch.table(f"depth{depth}", new)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def edges_within(edges: DataFrame, start: Column, hops: int) -> DataFrame:
    """``within_hops`` for many hops: the edges that leave a node of fewer hops than ``hops``, by one join a way with the nodes reached."""
    clean, nodes = call_edges(edges), reached(edges, start, hops)
    expanded = nodes.filter(F.col("depth") < hops)
    sides = [
        clean.join(expanded.filter(F.col("way") == way).select(F.col("node").alias(here)), here, "left_semi").select("src", "dst")
        for way, here in (("down", "src"), ("up", "dst"))
    ]
    return sides[0].union(sides[1]).distinct()


def dot(edges: DataFrame, name: str = "callgraph") -> DataFrame:
    """The graph as one DOT text; a report for graphs of a size that one can look at."""
    lines = edges.select(F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')).alias("line"))
    body = lines.agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("body"))
    return body.select(F.concat(F.lit(f"digraph {name} {{\n"), "body", F.lit("\n}")).alias("dot"))


def calls_of(methods: DataFrame, calls: DataFrame, locals_: DataFrame) -> DataFrame:
    """For each method its distinct calls and variables, sorted."""
    called = calls.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    named = locals_.groupBy(F.col("method").alias("name")).agg(F.array_sort(F.collect_set(locals_["name"])).alias("variables"))
    none = F.array().cast("array<string>")
    out = methods.select("name").distinct().join(called, "name", "left").join(named, "name", "left")
    return out.select("name", F.coalesce("calls", none).alias("calls"), F.coalesce("variables", none).alias("variables"))
