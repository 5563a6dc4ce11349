"""Segmented prefix scans: ordered operators whose groups are spread over tasks.

A window sorts each group in one task. Here a group with more rows than a limit is cut into slices by ranges of its order, from
quantile sketches. Rows are dealt by group and slice. A first pass reduces each slice of such groups to one row, a window over these few rows
gives what every slice carries in from those before (or after) it, and the second pass adds the carry to the window of
the slice alone. Without such groups it is one plain window.

The order's first column is a number, a date or a timestamp; rows that agree in it stay in one slice. Null comes first, as in
Spark's windows; null groups are a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.session import Scratch

#: Rows that one task sorts.
LIMIT = 1 << 20
#: Boundaries that are looked through one by one, and boundaries at most that are sent to all tasks (16 MB).
STRIDE, SENT = 32, 1_000_000
#: Slices of one group at most; beyond that they hold more rows.
PARTS = 10_000


@dataclass(frozen=True)
class Total:
    """The sum of all rows up to this one, or with ``own`` false up to the one before."""

    value: Column
    own: bool = True


@dataclass(frozen=True)
class Greatest:
    """The greatest value up to this row, or the one before."""

    value: Column
    own: bool = True


@dataclass(frozen=True)
class Latest:
    """The last value that isn't null up to this row, or the one before."""

    value: Column
    own: bool = True


@dataclass(frozen=True)
class Next:
    """The first value that isn't null after this row."""

    value: Column


class Slices:
    """Where the groups of ``rows`` that have more than ``limit`` rows are cut, by ``place``; other frames with both columns can be cut alike."""

    def __init__(self, rows: DataFrame, group: str, place: str, limit: int | None = None):
        self.group, self.place, self.bounds = group, place, None
        limit = limit or LIMIT
        keyed = rows.select(F.struct(F.col(group).alias("g")).alias("_hot"), F.col(place).alias("_place"))
        counts = keyed.groupBy("_hot").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        most, cuts = counts.agg(F.max("_n"), F.sum(F.ceil(F.col("_n") / limit))).first()
        if most is None:
            return
        limit = max(limit, most // PARTS)
        parts = -(-most // limit)
        steps = [k / parts for k in range(1, parts)]
        scratch = Scratch(rows.sparkSession, "slices")
        hot = scratch.table("hot", counts)
        sketched = keyed.join(hot.select("_hot"), "_hot", "left_semi").groupBy("_hot").agg(F.percentile_approx("_place", steps, max(10_000, 20 * parts)).alias("_bounds"))
        # Smaller groups take every so many of the boundaries.
        every = F.greatest(F.lit(1), F.floor(F.lit(parts) / F.ceil(F.col("_n") / limit)))
        kept = F.array_distinct(F.filter("_bounds", lambda b, i: (i + 1) % every == 0))
        coarse = F.filter(kept, lambda b, i: (i + 1) % STRIDE == 0)
        bounds = scratch.table("bounds", sketched.join(hot, "_hot").select("_hot", kept.alias("_bounds"), coarse.alias("_coarse")))
        self.bounds = F.broadcast(bounds) if cuts <= SENT else bounds

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_slice``: how many boundaries of its group lie below the row's place."""
        if self.bounds is None:
            return rows.withColumn("_slice", F.lit(0))
        place = F.col(self.place)

        def below(bounds: Column) -> Column:
            return F.size(F.filter(bounds, lambda b: b < place))

        found = let(below(F.col("_coarse")), lambda c: c * STRIDE + below(F.slice(F.col("_bounds"), c * STRIDE + 1, F.lit(STRIDE))))
        cut = rows.withColumn("_hot", F.struct(F.col(self.group).alias("g"))).join(self.bounds, "_hot", "left")
        return cut.withColumn("_slice", F.when(F.col("_bounds").isNotNull(), found).otherwise(0)).drop("_hot", "_bounds", "_coarse")


def scan(rows: DataFrame, group: str | list[str], by: list[str], slices: Slices | None = None, limit: int | None = None, **wanted: Total | Greatest | Latest | Next) -> DataFrame:
    """``rows`` with one column for each scan that is wanted, within groups in the order of the columns ``by``.

    ``slices`` are made from the first group and order column if not given. Rows that agree in all of ``by`` have an arbitrary
    order, as in a window.
    """
    groups = [group] if isinstance(group, str) else group
    slices = slices or Slices(rows, groups[0], by[0], limit)
    cut = slices.attach(rows).withColumn("_group", F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]))
    order = F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)])
    mine = Window.partitionBy("_group", "_slice")
    upto, backwards = mine.orderBy(*by), mine.orderBy(*[F.col(b).desc_nulls_last() for b in by]).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_group").orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local, pieces, carried, joined = {}, [], {}, {}
    for name, one in wanted.items():
        piece, carry = f"_piece_{name}", f"_carry_{name}"
        known = F.when(one.value.isNotNull(), order)
        frame = backwards if isinstance(one, Next) else upto.rowsBetween(Window.unboundedPreceding, 0 if one.own else -1)
        mine_, carry_ = F.col(name), F.col(carry)
        if isinstance(one, Total):
            local[name], own, over = F.sum(one.value).over(frame), F.sum(one.value), F.sum(piece).over(before)
            both = F.coalesce(mine_ + carry_, mine_, carry_)
        elif isinstance(one, Greatest):
            local[name], own, over = F.max(one.value).over(frame), F.max(one.value), F.max(piece).over(before)
            both = F.greatest(mine_, carry_)
        else:
            following = isinstance(one, Next)
            local[name] = F.last(one.value, ignorenulls=True).over(frame)
            own = (F.min_by if following else F.max_by)(one.value, known)
            over = F.last(piece, ignorenulls=True).over(after if following else before)
            both = F.coalesce(mine_, carry_)
        pieces.append(own.alias(piece))
        carried[carry], joined[name] = over, both
    done = cut.withColumns(local)
    if slices.bounds is None:
        return done.select(*rows.columns, *wanted)
    reduced = cut.groupBy("_group", "_slice").agg(*pieces)
    carries = reduced.withColumn("_last", F.max("_slice").over(Window.partitionBy("_group"))).filter("_last > 0").select("_group", "_slice", *[c.alias(n) for n, c in carried.items()])
    return done.join(carries, ["_group", "_slice"], "left").select(*rows.columns, *[c.alias(n) for n, c in joined.items()])
