"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of all their columns; pass two runs a Fisher-Yates
shuffle inside each bucket and writes it. Laid end to end, the buckets form one random order of the whole table, which is cut into
shards whose row counts differ by at most one (law ``rows``). Equal rows would share a bucket; where more than ``REPEATS`` of
them occur, or they take more than a ``PART``-th of a bucket's bytes, they are counted, kept once and dealt out anew with a number
each, so a bucket holds its share of them only and no task more than a bucket, whatever the copies. A bucket's first place in the order is the sum of the buckets before it, taken by
runs of ``RUN`` buckets, so that no task sees all of them.

Defined results: a null text counts as empty and keeps its row; repeated rows each get a slot of their own; an empty table
gives empty shards; columns of the input named ``shard`` or ``slot`` are replaced, others of any name are kept (a map isn't hashed).
The order depends on the rows and the seed alone, so a task that runs again writes the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import Scratch

SHARDS = 16
SEED = 20260101
BUCKET_BYTES = 8 << 20
REPEATS, PART, RUN = 1000, 8, 4096


def _first_rows(counts: DataFrame) -> DataFrame:
    """(bucket, first_row): how many rows the buckets before hold. ``counts``: bucket, n."""
    runs = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumn("inside", F.coalesce(F.sum("n").over(before.partitionBy("run").orderBy("bucket")), F.lit(0)))
    # A row for every RUN buckets.
    starts = runs.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(before.orderBy("run")), F.lit(0)).alias("start"))
    return inside.join(starts, "run").select("bucket", (F.col("start") + F.col("inside")).alias("first_row"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """Write ``docs`` in random order under ``path``, one folder a shard, and return them as read back with shard and slot."""
    spark, docs = docs.sparkSession, docs.drop("shard", "slot")
    scratch = Scratch(spark, "sharding")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    plain = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keys = [F.xxhash64(F.lit(seed + k), *plain).alias(f"key{k}") for k in range(2)]
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), *keys)
    counted = docs.select(*keys, size.alias("size")).groupBy("key0", "key1").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    often = scratch.table("often", counted.filter((F.col("n") > REPEATS) | (F.col("bytes") * PART > bucket_bytes)).select("key0", "key1"))
    keyed = packed.withColumn("number", F.lit(0).cast("long"))
    if not often.isEmpty():
        same = packed.join(often, ["key0", "key1"], "left_semi").groupBy("row", "key0", "key1").agg(F.count("*").alias("n"))
        again = same.select("row", "key0", "key1", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("number"))
        keyed = keyed.join(often, ["key0", "key1"], "left_anti").select(*again.columns).union(again)
    placed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key0", "number"), F.lit(buckets)))
    offsets = _first_rows(placed.groupBy("bucket").agg(F.count("*").alias("n")))
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    names = docs.columns

    def fisher_yates(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key0", "ascending"), ("key1", "ascending"), ("number", "ascending")])
        bucket, first = table["bucket"][0].as_py(), table["first_row"][0].as_py()
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(table.num_rows)
        at = first + np.arange(table.num_rows, dtype=np.int64)
        shard = at * shards // rows
        slot = at - -(-shard * rows // shards)
        taken = table.select(["row"]).take(pa.array(order)).combine_chunks()["row"].combine_chunks()
        return pa.Table.from_arrays([*taken.flatten(), pa.array(slot), pa.array(shard.astype(np.int32))], [*names, "slot", "shard"])

    shuffled = placed.join(offsets, "bucket").groupBy("bucket").applyInArrow(fisher_yates, schema)
    shuffled.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all documents' shards: law ``rows``, 16 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = write_shards(docs, Scratch(spark, "shards").path("out"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return done.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
