"""Tables that are changed in place, against the same changes of frames."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dml
from millrace.sources.stored import BUCKET, Stored, cascade, delete_owned


def files_of(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def bucket(name):
    return int(name.split(f"{BUCKET}=")[1].split("/")[0])


def same_but(before, after, buckets):
    """Only files of these buckets differ."""
    return {bucket(n) for n in set(before.items()) ^ set(after.items()) for n in [n[0]]} <= set(buckets)


@pytest.fixture
def people(spark, tmp_path):
    rows = spark.range(5000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 7).alias("n"))
    return Stored.create(rows, str(tmp_path / "people"), "id", 64), rows


def test_patch_writes_its_buckets_only(spark, rows, people):
    table, base = people
    patches = spark.createDataFrame([(5, "new", None), (77, None, -1), (5, "newer", 9), (None, "x", 1), (99_999, "y", 1)], "id int, name string, n long")
    before = files_of(table.path)
    buckets = table.patch(patches)
    assert 2 <= len(buckets) <= 4 and same_but(before, files_of(table.path), buckets)
    assert rows(table.read()) == rows(dml.patch(base, patches.withColumn("id", F.col("id").cast("long")), "id"))
    assert rows(table.lookup([5, 77, 123])) == [(123, "n123", 4), (5, "newer", 9), (77, "n77", -1)]
    assert table.patch(patches.limit(0)) == []
    plan = table.read([3])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BUCKET}" in plan or f"{BUCKET}" in plan.split("PartitionFilters")[1][:60]


def test_delete_and_upsert(spark, rows, people):
    table, base = people
    buckets = table.delete(base.filter("id % 500 = 0").select("id"))
    assert len(buckets) <= 10 and rows(table.read()) == rows(base.filter("id % 500 <> 0"))
    before = files_of(table.path)
    new = spark.createDataFrame([(1, "one", 1), (500, "back", 2), (-4, None, None)], "id long, name string, n long")
    buckets = table.upsert(new)
    assert same_but(before, files_of(table.path), buckets)
    assert rows(table.read()) == rows(base.filter("id % 500 <> 0 AND id <> 1").union(new))
    # A change may read the table that it changes, and may leave nothing of it.
    table.delete(table.read().select("id"))
    assert table.read().count() == 0 and not files_of(table.path)
    table.insert(new)
    assert rows(table.read()) == rows(new)


def test_insert_makes_keys(spark, tmp_path):
    table = Stored.create(spark.createDataFrame([], "id string, name string, at timestamp"), str(tmp_path / "t"), "id", 4)
    table.insert(spark.createDataFrame([("a",), ("b",)], "name string"), "at")
    assert table.read().filter("length(id) = 36 AND at IS NOT NULL").count() == 2


def test_merge(spark, rows, tmp_path):
    docs = Stored.create(spark.createDataFrame([("a", "old", 1, 0), ("b", "kept", 2, 0)], "k string, intent string, passed int, updated_at int"), str(tmp_path / "docs"), "k", 8)
    history = spark.createDataFrame([("a", 3, "x", None), ("a", 4, None, 7), ("a", 2, "w", 5), ("c", 9, None, 1), (None, 1, "z", 1)], "k string, ts int, intent string, passed int")
    docs.merge(history, "ts", ["intent", "passed"])
    assert rows(docs.read()) == [("a", "x", 7, 4), ("b", "kept", 2, 0), ("c", None, 1, 9)]
    docs.merge(history, "ts", ["intent", "passed"])  # a second time changes nothing
    assert rows(docs.read()) == [("a", "x", 7, 4), ("b", "kept", 2, 0), ("c", None, 1, 9)]


def test_children(spark, rows, tmp_path):
    p = spark.range(300).select("id", (F.col("id") % 3).alias("owner"), F.lit(4).cast("long").alias("n"))
    c = p.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("item"))
    parents, children = Stored.create(p, str(tmp_path / "p"), "id", 32), Stored.create(c, str(tmp_path / "c"), "id", 32)
    asked = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (6, 2, 1), (7, 3, 1), (8, 9, 2), (None, 1, 0)], "id long, item int, user long")
    buckets = delete_owned(parents, children, asked, "item", "owner", "user", "n")
    assert len(buckets) <= 4
    assert rows(parents.lookup([6, 7, 8])) == [(6, 0, 3), (7, 1, 3), (8, 2, 4)]
    assert rows(children.read()) == rows(c.filter("NOT (id = 6 AND item = 1 OR id = 7 AND item = 3)"))
    gone = spark.createDataFrame([(6,), (200,)], "id int")
    cascade(parents, children, gone)
    assert parents.read().count() == 298 and children.read().count() == 298 * 4 - 1


def test_lost_change_is_recovered(spark, rows, people):
    table, base = people
    hot = Stored.create(base.withColumn("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))), table.path + "-hot", "id", 16)
    assert hot.read().filter("id = 1").count() == 1668
    buckets = table.touched(base.filter("id < 3").select("id"))
    table.stage(buckets, table.read(buckets).filter("id >= 3"))
    assert table.read().count() == 5000  # the driver is lost here: staged, but not in place
    again = Stored(spark, table.path, "id", table.schema, 64)
    again.patch(spark.createDataFrame([(random.Random(1).randrange(3, 5000), "p", 1)], "id long, name string, n long"))
    assert again.read().count() == 4997 and again.read().filter("id < 3").count() == 0
    # Staged rows without the list of their buckets are no change.
    table.stage([0], base.limit(0))
    os.remove(f"{table.path}.pending/buckets/_SUCCESS")
    table.recover()
    assert table.read().count() == 4997
