"""Tables that are changed where they are stored.

A table is Parquet in one folder for each bucket of its key. A change reads and writes the buckets of the keys that it names, and no
others: their new rows are staged beside the table, and then take their places by Spark's dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from millrace.operators import dml
from millrace.session import Scratch

BUCKET = "_bucket"


def delete_path(spark: SparkSession, path: str) -> None:
    """A file or folder in any store that Spark writes; nothing happens if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass(frozen=True)
class Stored:
    """A table at ``path``, bucketed by ``key``; a table of children is bucketed by its parent's key.

    Rows may share a key, and null keys share a bucket; no change reaches them, as null equals nothing. One change at a time: nobody
    else may write meanwhile, and readers that are in a bucket while it is replaced fail. A change whose driver is lost after
    staging is carried out by the next one, or by ``recover``; one lost before has done nothing.
    """

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 256

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 256) -> Stored:
        """A new table of ``rows``; one that is there is replaced."""
        made = cls(rows.sparkSession, path, key, rows.schema, buckets)
        delete_path(made.spark, made._pending)
        made._dealt(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(path)
        return made

    @property
    def _pending(self) -> str:
        return f"{self.path.rstrip('/')}.pending"

    def bucket_of(self, key: Column) -> Column:
        """The bucket of a key of whatever type that can be cast to the table's."""
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        # A rebalance splits the bucket of a hot key over several tasks and files, and puts small buckets together.
        return rows.select(*self.schema.names).withColumn(BUCKET, self.bucket_of(F.col(self.key))).hint("rebalance", BUCKET)

    def _whole(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, of which alone the files are listed in the plan."""
        rows = self._whole() if buckets is None else self._whole().filter(F.col(BUCKET).isin(buckets))
        return rows.select(*self.schema.names)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of a few keys, from their buckets."""
        wanted = F.array(*[F.lit(k).cast(self.schema[self.key].dataType) for k in keys])
        found = self.spark.range(1).select(F.explode(F.transform(wanted, self.bucket_of)).alias("b"))
        return self.read(sorted({r.b for r in found.collect()})).filter(F.array_contains(wanted, F.col(self.key)))

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys, ``buckets`` of them at most."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.key))).distinct().collect())

    def stage(self, buckets: list[int], rows: DataFrame) -> None:
        """Write what the buckets will hold; ``recover`` puts it in place."""
        delete_path(self.spark, self._pending)
        self._dealt(rows).write.partitionBy(BUCKET).parquet(f"{self._pending}/rows")
        self.spark.createDataFrame([(b,) for b in buckets], "b int").coalesce(1).write.parquet(f"{self._pending}/buckets")

    def recover(self) -> None:
        """Carry out a staged change, if there is one. It may be done twice."""
        if not exists(self.spark, f"{self._pending}/buckets/_SUCCESS"):
            return
        buckets = [r.b for r in self.spark.read.schema("b int").parquet(f"{self._pending}/buckets").collect()]
        staged = self.spark.read.schema(self._whole().schema).parquet(f"{self._pending}/rows")
        held = {r[0] for r in staged.select(BUCKET).distinct().collect()}
        self._dealt(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for gone in set(buckets) - held:
            delete_path(self.spark, f"{self.path}/{BUCKET}={gone}")
        delete_path(self.spark, self._pending)
        self.spark.catalog.refreshByPath(self.path)

    def _change(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        self.recover()
        scratch = Scratch(self.spark, "change")
        kept = scratch.table("changes", changes.withColumn(self.key, F.col(self.key).cast(self.schema[self.key].dataType)))
        buckets = self.touched(kept)
        if buckets:
            self.stage(buckets, change(self.read(buckets), kept))
            self.recover()
        scratch.drop("changes")
        return buckets

    def insert(self, new: DataFrame, stamp: str | None = None) -> None:
        """Rows are added to their buckets as files of their own; missing keys and stamps are made as in ``dml.insert``."""
        self.recover()
        made = dml.insert(self.read([]), new, self.key, stamp)
        self._dealt(made).write.mode("append").partitionBy(BUCKET).parquet(self.path)
        self.spark.catalog.refreshByPath(self.path)

    def patch(self, patches: DataFrame, by: str | None = None, fields_set: str | None = None) -> list[int]:
        """``dml.patch`` of the stored rows; the buckets that were written."""
        return self._change(patches, lambda old, p: dml.patch(old, p, self.key, by, fields_set))

    def delete(self, keys: DataFrame) -> list[int]:
        """Without all rows of the keys."""
        return self._change(keys.select(self.key), lambda old, k: old.join(k, self.key, "left_anti"))

    def upsert(self, new: DataFrame) -> list[int]:
        """Rows replaced by the new ones with their key, and the other new ones."""
        return self._change(new, lambda old, n: old.join(n.select(self.key), self.key, "left_anti").unionByName(n.select(*self.schema.names)))

    def merge(self, history: DataFrame, stamp: str, fields: list[str], updated: str = "updated_at") -> list[int]:
        """Documents with patches laid over them: of each field the last value by ``stamp``, and ``updated`` the last stamp; documents that aren't there are made."""

        def laid(old: DataFrame, h: DataFrame) -> DataFrame:
            last = dml.merge_patches(h, self.key, stamp, fields).withColumnRenamed("updated_at", updated).filter(F.col(self.key).isNotNull())
            new = last.join(old.select(self.key), self.key, "left_anti")
            return dml.patch(old, last, self.key).unionByName(new, allowMissingColumns=True)

        return self._change(history, laid)


def cascade(parents: Stored, children: Stored, keys: DataFrame) -> tuple[list[int], list[int]]:
    """The parents of the keys go, and the children in the same buckets. The children go first, so that a lost change can be asked for again."""
    gone = keys.select(F.col(parents.key).alias(children.key))
    return children.delete(gone), parents.delete(keys)


def delete_owned(parents: Stored, children: Stored, requests: DataFrame, child_key: str, owner: str, user: str, count: str) -> list[int]:
    """``dml.delete_owned`` of two stored tables; requests name the parent (``parents.key``), the child and the user.

    Both tables' new buckets are staged before either is changed. ``children`` has to be in as many buckets by the column of the same name.
    """
    if parents.key != children.key or parents.buckets != children.buckets:
        raise ValueError("parents and children have to share the key and the number of buckets")
    parents.recover()
    children.recover()
    buckets = parents.touched(requests)
    if buckets:
        wanted = requests.select(parents.key, child_key, user).distinct()
        old = children.read(buckets)
        # A request counts for the child below the parent that it names.
        named = F.struct(F.col(parents.key).alias("p"), F.col(child_key).alias("c"))
        left, kept = dml.delete_owned(parents.read(buckets), old.withColumn("_child", named), wanted.withColumn("_child", named).select("_child", user), parents.key, "_child", owner, user, count)
        parents.stage(buckets, left)
        children.stage(buckets, kept)
        children.recover()
        parents.recover()
    return buckets
