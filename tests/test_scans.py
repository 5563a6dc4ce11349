"""Prefix scans over slices against plain windows, with one group that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import joins, scans, trees, windows
from millrace.operators.scans import Greatest, Latest, Next, Slices, Total, scan


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        user = 7 if i % 3 == 0 else rng.choice([None, *range(40)])
        rows.append((i, user, rng.choice([None, *range(500)]) if i % 50 == 0 else rng.randrange(100_000), rng.choice([None, -1, 1, 2]), rng.choice("abc")))
    return spark.createDataFrame(rows, "id int, user int, ts int, v int, kind string").repartition(5).cache()


def same(left, right):
    return sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.collect()), key=repr)


@pytest.mark.parametrize("limit", [17, 100, 10_000])
def test_scans_equal_windows(events, limit):
    order = Window.partitionBy("user").orderBy("ts", "id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    a = F.when(F.col("kind") == "a", F.col("id"))
    want = events.select(
        "*", F.sum("v").over(upto).alias("s"), F.sum("v").over(before).alias("t"), F.max("v").over(upto).alias("g"), F.max("v").over(before).alias("h"), F.last(a, True).over(upto).alias("l"),
        F.last(a, True).over(before).alias("m"), F.first(a, True).over(after).alias("n"), F.lead("ts").over(order).alias("o"),
    )
    got = scan(events, "user", ["ts", "id"], limit=limit, s=Total(F.col("v")), t=Total(F.col("v"), False), g=Greatest(F.col("v")), h=Greatest(F.col("v"), False), l=Latest(a), m=Latest(a, False), n=Next(a), o=Next(F.struct("ts")))
    assert same(got.withColumn("o", F.col("o.ts")), want)


def test_a_hot_group_is_in_many_slices(events):
    slices = Slices(events, "user", "ts", 50)
    cut = slices.attach(events)
    sizes = {(r.user, r._slice): r["count"] for r in cut.groupBy("user", "_slice").count().collect()}
    hot = [n for (user, _), n in sizes.items() if user == 7]
    assert len(hot) >= 15 and max(hot) <= 150 and sum(hot) >= 1000
    tasks = cut.repartition(16, "user", "_slice").filter("user = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 8
    assert Slices(events, "user", "ts", 5000).bounds is None


def test_many_boundaries(spark):
    rows = spark.range(20_000).select((F.col("id") % 3 > 0).alias("g"), "id")
    got = scan(rows, "g", ["id"], limit=90, n=Total(F.lit(1)))
    assert same(got, rows.withColumn("n", F.sum(F.lit(1)).over(Window.partitionBy("g").orderBy("id"))))


def test_operators_do_not_depend_on_slices(spark, events):
    rows = events.filter("ts IS NOT NULL").dropDuplicates(["user", "ts"]).withColumn("at", F.timestamp_seconds("ts"))
    starts = rows.filter("id % 7 = 0").select("user", F.col("ts").alias("start"), F.col("kind").alias("name"))
    b = F.col("kind") == "b"
    for one in (
        lambda n: windows.intervals(rows, "user", "ts", F.lit(-1), limit=n),
        lambda n: windows.segments(rows, "user", ["ts"], b, limit=n),
        lambda n: windows.first_closed(windows.running(rows, "user", ["ts"], F.col("v"), limit=n), "user", "ts", limit=n),
        lambda n: windows.ahead(rows, "user", ["ts"], b, limit=n),
        lambda n: windows.nearest_before(rows, "user", ["ts"], F.when(b, F.col("id")), limit=n),
        lambda n: windows.debounced(rows, "user", "at", 60, limit=n),
        lambda n: joins.enclosing(rows, starts, "user", "ts", "start", ["start", "name"], limit=n),
        lambda n: trees.flatten(rows.select("user", F.col("id").cast("string").alias("name"), "ts", (F.col("ts") + 1).alias("end")), "user", "name", "ts", "end", limit=n),
    ):
        assert same(one(40), one(None))


def test_ahead_equals_window(events):
    rows = events.filter("ts IS NOT NULL")
    order = Window.partitionBy("user").orderBy("ts", "id").rowsBetween(1, 5)
    c = F.col("kind") == "c"
    assert same(windows.ahead(rows, "user", ["ts", "id"], c, limit=30), rows.withColumn("seen_ahead", F.coalesce(F.max(c.cast("int")).over(order), F.lit(0)) == 1))


def test_empty(events):
    assert scan(events.limit(0), "user", ["ts"], limit=2, n=Total(F.lit(1))).collect() == []
    assert scans.LIMIT > 1000
