"""Pages by ranges, locale order, walks of many hops and kept results."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, listing, pages, trees
from millrace.sources import results

BY = [("v", False), ("name", True), ("k", True)]


def plain(rows, by, number, limit):
    return [tuple(r) for r in listing.page(rows.orderBy(*pages.ordering(by)), number, limit).collect()]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    pick = random.Random(3)
    made = [(k, pick.choice([None, 1.5, 2.5, float("nan"), pick.random()]), pick.choice([None, "", "é", "b", "B", "a" * 40])) for k in range(4000)]
    at = str(tmp_path_factory.mktemp("pages") / "rows")
    spark.createDataFrame(made, "k long, v double, name string").repartition(5).write.parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize("number", [1, 2, 150, 333, 399, 400, 401])
def test_page_equals_sorted_rows(table, number):
    got = pages.page(table, BY, number, 10, most=60, position="position").collect()
    assert repr([tuple(r)[:3] for r in got]) == repr(plain(table, BY, number, 10))
    assert [r.position for r in got] == list(range(number * 10 - 9, number * 10 + 1))[: len(got)]


def test_only_the_pages_range_is_left(table):
    few, before = pages.narrowed(table, BY, 2345, 10, most=60)
    assert few.count() <= 60 and before + 10 <= few.count()


def test_pages_follow_each_other_over_ties(spark):
    """One value for all rows, and rows that are wholly equal: every row is on one page."""
    rows = spark.range(900).select((F.col("id") % 3).alias("k"), F.lit("x").alias("v"))
    by = [("v", True), ("k", False)]
    seen = [tuple(r) for n in range(1, 11) for r in pages.page(rows, by, n, 90, most=20).collect()]
    assert seen == [(k, "x") for k in (2, 1, 0) for _ in range(300)]


def test_page_edges(spark, table):
    assert pages.page(table.limit(0), BY, 1, 10, most=1).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 5, table.schema)
    assert pages.page(nulls, BY, 2, 3, most=1, position="position").collect()[0].position == 4
    for number, limit in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            pages.page(table, BY, number, limit)


def test_locale_order_of_names(spark):
    names = ["b", "É", "e", "Z", "f", "_x", "中", "一", "10", "9", "E", "Ä", "a"]
    tree = spark.createDataFrame([(n, "", n, 0, n != "Z") for n in names], "path string, parent string, name string, depth int, is_file boolean")
    got = [r.name for r in trees.children(tree, "", "UNICODE").collect()]
    assert got == ["Z", "_x", "10", "9", "a", "Ä", "b", "e", "E", "É", "f", "一", "中"]
    assert [r.name for r in trees.tree_order(tree, "UNICODE").collect()] == got
    assert [r.name for r in trees.children(tree, "").collect()][-4:] == ["ä".upper(), "É", "一", "中"]  # without a collation as before


def test_twenty_hops_on_rings(spark):
    """A ring of 60, a shortcut and a side branch, against a breadth-first walk."""
    edges = [(str(k), str((k + 1) % 60)) for k in range(60)] + [("3", "30"), ("5", "s1"), ("s1", "s2"), ("0", "0"), ("1", "<operator>.add"), ("3", "30")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    got = {(r.way, r.node): r.depth for r in graph.reached(frame, F.col("node") == "0", 20).collect()}
    want = {}
    for way in ("down", "up"):
        level, depth = {"0"}, 0
        while level and depth <= 20:
            want.update({(way, n): depth for n in level})
            pairs = [(a, b) if way == "down" else (b, a) for a, b in edges if not b.startswith("<operator>") and a != b]
            level = {b for a, b in pairs if a in level and (way, b) not in want}
            depth += 1
    assert got == want


def test_walk_ends_when_nothing_is_new(spark):
    frame = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    found = graph.reached(frame, F.col("node") == "a", 10**6, ("down",))
    assert sorted((r.node, r.depth) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert graph.reached(frame, F.col("node") == "nowhere", 3).count() == 0


def test_edges_within_equals_unrolled_joins(spark, rows):
    pick = random.Random(5)
    frame = spark.createDataFrame([(str(pick.randrange(40)), str(pick.randrange(40))) for _ in range(60)], "src string, dst string")
    start = F.col("node").isin("1", "2")
    for hops in (1, 3):
        assert rows(graph.edges_within(frame, start, hops)) == rows(graph.within_hops(frame, start, hops))


def test_results_are_kept(spark, tmp_path):
    at, root = str(tmp_path / "rows"), f"file://{tmp_path}/kept"
    spark.range(10).write.parquet(at)

    def made(least=3):
        return spark.read.parquet(at).filter(F.col("id") >= least).groupBy((F.col("id") % 2).alias("odd")).agg(F.count("*").alias("n"))

    first = results.reused(made(), "counts", root)
    again = results.reused(made(), "counts", root)
    assert again.inputFiles() == first.inputFiles() and {r.odd: r.n for r in again.collect()} == {0: 3, 1: 4}
    # Another plan or version is another result; the first stays.
    other = results.reused(made(4), "counts", root)
    assert other.inputFiles() != first.inputFiles() and {r.odd: r.n for r in other.collect()} == {0: 3, 1: 3}
    assert results.reused(made(), "counts", root, version="2").inputFiles() != first.inputFiles()
    assert results.reused(made(), "counts", root).inputFiles() == first.inputFiles()
    # A refresh replaces the copy.
    fresh = results.reused(made(), "counts", root, refresh=True)
    assert fresh.inputFiles() != first.inputFiles() and results.reused(made(), "counts", root).inputFiles() == fresh.inputFiles()
    # A changed input is seen, and so is a copy that was never finished.
    spark.range(10, 14).write.mode("append").parquet(at)
    changed = results.reused(made(), "counts", root)
    assert {r.odd: r.n for r in changed.collect()} == {0: 5, 1: 6}
    folder = os.path.dirname(changed.inputFiles()[0]).removeprefix("file://")
    os.remove(f"{folder}/_SUCCESS")
    assert results.reused(made(), "counts", root).inputFiles() != changed.inputFiles()
    results.forget(spark, "counts", root)
    assert not os.path.exists(tmp_path / "kept/results/counts")


def test_long_plans_are_told_apart(spark, tmp_path):
    """Plans that differ beyond the columns that Spark prints by default."""
    at = str(tmp_path / "rows")
    spark.range(3).write.parquet(at)
    wide = lambda last: spark.read.parquet(at).select(*[F.lit(k).alias(f"c{k}") for k in range(60)], F.lit(last).alias("z"))
    assert results.fingerprint(wide(1)) == results.fingerprint(wide(1)) != results.fingerprint(wide(2))
