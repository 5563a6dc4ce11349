"""Path expressions; paths use ``/`` and have no leading slash unless the caller gives one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash, empty at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Text after the last dot of the path in lower case; a path without a dot is its own extension."""
    return F.lower(F.substring_index(path, ".", -1))


def node_extension(path: Column) -> Column:
    """The last dot and what follows, in lower case; empty for names without one and for names that only start with one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")


def archive_name(name: Column) -> Column:
    """The name up to its last dot; the whole name where that leaves nothing."""
    cut = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(cut == "", name).otherwise(cut)


def first_dot_name(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def trim_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+", "")


def join_path(parent: Column, name: Column) -> Column:
    return trim_slashes(F.concat_ws("/", parent, name))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def prefixes(path: Column) -> Column:
    """All prefixes of a path, itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def inside(base: Column, path: Column) -> Column:
    """Whether a path, its ``.`` and ``..`` resolved, is the base or lies below it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    resolved = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")),
        lambda acc, p: F.struct(
            F.when(p != "..", F.concat(acc["at"], F.array(p))).otherwise(F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).alias("at"),
            (acc["ok"] & ((p != "..") | (F.size(acc["at"]) > 0))).alias("ok"),
        ),
    )
    whole = F.array_join(resolved["at"], "/")
    return resolved["ok"] & ((whole == base) | F.startswith(whole, F.concat(base, F.lit("/"))))


def same_or_below_any(path: Column, target: Column) -> Column:
    """Whether a path is the target, or ends with it after a slash."""
    return (path == target) | F.endswith(path, F.concat(F.lit("/"), target))
