"""Changes to tables as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(rows: DataFrame, new: DataFrame, key: str, stamp: str | None = None) -> DataFrame:
    """Rows and new ones; a new row without a key gets a uuid, one without a time stamp the current time."""
    if key not in new.columns:
        new = new.withColumn(key, F.uuid())
    if stamp and stamp not in new.columns:
        new = new.withColumn(stamp, F.current_timestamp())
    return rows.unionByName(new, allowMissingColumns=True)


def patch(rows: DataFrame, patches: DataFrame, key: str, by: str | None = None, fields_set: str | None = None) -> DataFrame:
    """Partial update by key. Null leaves a column as it is, unless the array column ``fields_set`` names it: then it becomes null.

    Of several patches of a key each column takes its last value by ``by``; without that the largest, null being the least.
    """
    fields = [c for c in patches.columns if c not in (key, by, fields_set)]
    sets = {c: F.array_contains(fields_set, c) if fields_set else F.col(c).isNotNull() for c in fields}
    order = F.col(by) if by else None
    change = patches.groupBy(key).agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(sets[c], order if by else F.struct(F.lit(1), F.col(c)))).alias(f"_{c}") for c in fields])
    return rows.join(change, key, "left").select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c) if c in fields else c for c in rows.columns])


def upsert(rows: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows replaced by the new ones with their key, and the other new ones, newest first."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new).orderBy(F.col(stamp).desc(), key)


def delete_owned(parents: DataFrame, children: DataFrame, requests: DataFrame, parent_key: str, child_key: str, owner: str, user: str, count: str) -> tuple[DataFrame, DataFrame]:
    """Children that their parent's owner asks to delete go, and each parent's ``count`` is less by those; other requests do nothing.

    ``children`` and ``requests`` hold ``child_key``, ``children`` ``parent_key`` too; repeated requests count once, children that share a key go together.
    """
    asked = children.select(child_key, parent_key).join(requests.select(child_key, F.col(user).alias("_user")).distinct(), child_key)
    granted = asked.join(parents.select(parent_key, F.col(owner).alias("_owner")), parent_key).filter("_user = _owner")
    fewer = granted.groupBy(parent_key).agg(F.count("*").alias("_gone"))
    left = parents.join(fewer, parent_key, "left").withColumn(count, F.col(count) - F.coalesce("_gone", F.lit(0))).select(*parents.columns)
    return left, children.join(granted.select(child_key, parent_key), [child_key, parent_key], "left_anti")


def delete(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents and their children."""
    gone = keys.select(F.col(keys.columns[0]).alias("_gone"))
    return (
        parents.join(gone, F.col(parent_key) == F.col("_gone"), "left_anti"),
        children.join(gone, F.col(child_key) == F.col("_gone"), "left_anti"),
    )


def merge_patches(history: DataFrame, key: str, stamp: str, fields: list[str]) -> DataFrame:
    """Append-only patches to documents: the last value of each field, and when the key last changed."""
    return history.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(stamp))).alias(f) for f in fields], F.max(stamp).alias("updated_at"))


def seed(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows, or the seed where there are none."""
    empty = rows.limit(1).agg((F.count("*") == 0).alias("_empty"))
    return rows.unionByName(first.join(F.broadcast(empty), F.col("_empty")).drop("_empty"))


def rename(tree: DataFrame, old: str, new: str) -> DataFrame:
    """A file or a directory with all below it under its new path."""
    moved = (F.col("path") == old) | F.startswith("path", F.lit(f"{old}/"))
    return tree.withColumn("path", F.when(moved, F.concat(F.lit(new), F.expr(f"substr(path, {len(old) + 1})"))).otherwise(F.col("path")))


def remove(tree: DataFrame, path: str) -> DataFrame:
    """Without a node and what lies below; nothing happens if it isn't there."""
    return tree.filter(~((F.col("path") == path) | F.startswith("path", F.lit(f"{path}/"))))


def create(tree: DataFrame, path: str, is_file: bool) -> DataFrame:
    """With a new node; an existing one stays as it is."""
    new = tree.sparkSession.createDataFrame([(path, is_file)], "path string, is_file boolean")
    return tree.unionByName(new.join(tree.select("path"), "path", "left_anti"), allowMissingColumns=True)


def without_artifacts(tree: DataFrame) -> DataFrame:
    return tree.filter(~F.rlike("path", F.lit(r"\.(o|gcda|gcno|info)$")))
