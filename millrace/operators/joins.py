"""Joins: defaults, fallbacks, priorities, latest rows, intervals.

None of them gathers a group in Python. Where a side may be small Spark's own threshold decides about broadcasting; skewed
keys of the others are left to adaptive skew joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.operators.scans import Latest, scan


def left_default(left: DataFrame, right: DataFrame, on: str | list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join; the right side's columns take defaults where there is no match or null."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fallback_unique(left: DataFrame, right: DataFrame, full: str, short: str, value: str) -> DataFrame:
    """``value`` of the right row with the same full key; else of the only right row with the same short key; else null."""
    exact = right.groupBy(full).agg(F.min(value).alias("_exact"))
    only = right.groupBy(short).agg(F.min(value).alias("_short"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return left.join(exact, full, "left").join(only, short, "left").withColumn(value, F.coalesce("_exact", "_short")).drop("_exact", "_short")


def by_priority(sources: list[DataFrame], key: str, tie: str) -> DataFrame:
    """For each key the row of the first source that has it; ``priority`` tells which."""
    out = None
    for k, source in enumerate(sources):
        source = source.withColumn("priority", F.lit(k))
        out = source if out is None else out.unionByName(source)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("priority", tie))).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key: one aggregate, combined map-side, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_last"))
    return best.select(*keys, "_last.*")


def latest_fields(rows: DataFrame, key: str, by: str, fields: list[str]) -> DataFrame:
    """For each key the last value that isn't null of each field: a shallow merge of patches."""
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(by))).alias(f) for f in fields])


def enclosing(points: DataFrame, starts: DataFrame, group: str, at: str, start: str, names: list[str], limit: int | None = None) -> DataFrame:
    """Points with the columns ``names`` of the last start at or before them in their group: an as-of join.

    One sort of both sides by group and place, no comparison of all pairs; large groups are spread over tasks.
    """
    p = points.withColumn("_is_point", F.lit(1)).withColumn("_at", F.col(at))
    s = starts.select(group, F.lit(0).alias("_is_point"), F.col(start).alias("_at"), F.struct(start, *[n for n in names if n != start]).alias("_start"))
    both = p.unionByName(s, allowMissingColumns=True)
    found = scan(both, group, ["_at", "_is_point"], limit=limit, _found=Latest(F.col("_start"))).filter("_is_point = 1")
    return found.select(*points.columns, *[F.col(f"_found.{n}").alias(n) for n in names])


def after_first(rows: DataFrame, key: str, by: str, first: Column, then: Column) -> DataFrame:
    """Rows that fulfil ``then`` later than the key's first row that fulfils ``first``."""
    start = F.min(F.when(first, F.col(by))).over(Window.partitionBy(key))
    return rows.withColumn("first_at", start).filter(then & (F.col(by) > F.col("first_at")))


def missing(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def present(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def zipped(rows: DataFrame, files: str, names: str, fallback: str) -> DataFrame:
    """Arrays paired by place, one row each; a missing name falls back to a field of the file."""
    pairs = F.arrays_zip(F.col(files).alias("file"), F.col(names).alias("name"))
    out = rows.select(*[c for c in rows.columns if c not in (files, names)], F.posexplode(pairs).alias("place", "pair"))
    return out.select("*", F.col("pair.file").alias("file"), F.coalesce("pair.name", F.col("pair.file")[fallback]).alias("name")).drop("pair")


def _runs(n: int, chars: int) -> Callable[[Column], Column]:
    """Hashes of the different runs of n words of an array, or for n = 0 of ``chars`` characters of a text."""

    def of(w: Column) -> Column:
        size, length = F.size(w) if n else F.char_length(w), n or chars

        def one(i: Column) -> Column:
            return F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " ") if n else F.substring(w, i, F.lit(chars)))

        places = F.sequence(F.lit(1), size - (length - 1)) if length else F.array(F.lit(1))
        return F.when(size >= length, F.array_distinct(F.transform(places, one))).otherwise(F.array().cast("array<bigint>"))

    return of


def containing(texts: DataFrame, items: DataFrame, key: str, text: str, item: str, width: int = 3) -> DataFrame:
    """All pairs of a text and an item that it contains, exactly: the columns of both. ``key`` tells texts apart, and may be null; a null text contains nothing.

    An item's inner words (all but its first and last, which may go on in the text) are words of the text. The first ``width`` of them
    are looked up by hash among the text's runs of words; of items without inner words the first ``width`` characters among the
    text's. Only keys and hashes are joined, and then the pairs that meet are checked exactly.
    """
    words = F.split(F.col(item), " ")
    inner = F.slice(words, F.lit(2), F.least(F.lit(width), F.greatest(F.size(words) - 2, F.lit(0))))
    probed = items.filter(F.col(item).isNotNull()).withColumn("_words", F.size(inner)).withColumn("_chars", F.when(F.col("_words") == 0, F.least(F.lit(width), F.char_length(item))))
    probed = probed.withColumn("_probe", F.xxhash64(F.when(F.col("_words") > 0, F.array_join(inner, " ")).otherwise(F.substring(F.col(item), F.lit(1), F.col("_chars")))))
    kinds = sorted((r["_words"], r["_chars"] or 0) for r in probed.select("_words", "_chars").distinct().collect())  # at most 2 width + 1 rows
    near = None
    for n, chars in kinds:

        source = F.split(F.col(text), " ") if n else F.col(text)
        places = texts.filter(F.col(text).isNotNull()).select(key, F.explode(let(source, _runs(n, chars))).alias("_probe"))
        mine = probed.filter((F.col("_words") == n) & (F.coalesce("_chars", F.lit(0)) == chars)).select(F.col(item).alias("_item"), "_probe")
        one = places.join(mine, "_probe").select(key, "_item").distinct()
        near = one if near is None else near.union(one)
    if near is None:
        return texts.join(items, F.lit(False))
    # Texts without a key meet what any of them is near to; the check is exact all the same.
    near = near.withColumnRenamed(key, "_key")
    pairs = texts.join(near, F.col(key).eqNullSafe(F.col("_key"))).filter(F.contains(text, F.col("_item"))).drop("_key")
    return pairs.join(items, F.col("_item") == F.col(item)).drop("_item")
