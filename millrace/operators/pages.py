"""Pages far into an ordered listing, without sorting what lies before them.

``listing.page`` sorts all rows up to the page. Here rows are counted by ranges of the order, between boundaries from a small sample, until
the ranges that hold the page have few rows; these alone are sorted. A pass reads the order's columns of the rows that are left; a
billion rows take two or three passes, and nothing but the page is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from millrace.functions.arrays import let

#: Rows that are sorted at the end.
MOST = 1 << 20
#: Ranges of a pass, and rows of the sample that they are chosen from.
RANGES, SAMPLE = 256, 8_192
#: Boundaries that are looked through one by one.
STRIDE = 16

Order = list[tuple[str, bool]]


def ordering(by: Order) -> list[Column]:
    """Sort keys of (column, ascending) pairs; null comes last in both directions, as in ``listing.ordered``."""
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in by]


def _before(a: list[Column], b: list[Column], by: Order) -> Column:
    """Whether the keys ``a`` come before the keys ``b``."""
    found = F.lit(False)
    for x, y, (_, up) in reversed(list(zip(a, b, by, strict=True))):
        first = F.coalesce(x < y if up else x > y, F.lit(False)) | (x.isNotNull() & y.isNull())
        found = first | (x.eqNullSafe(y) & found)
    return found


def _literals(row, rows: DataFrame, by: Order) -> list[Column]:
    return [F.lit(v).cast(rows.schema[c].dataType) for v, (c, _) in zip(row, by, strict=True)]


def _bounds(rows: DataFrame, by: Order, total: int) -> list:
    """At most RANGES different keys in order, from a sample."""
    keys = rows.select(*[c for c, _ in by])
    taken = keys.sample(min(1.0, SAMPLE / total), 7).orderBy(*ordering(by)).limit(2 * SAMPLE).collect()
    taken = taken or [keys.first()]
    return reduce(lambda kept, row: kept if kept and kept[-1] == row else [*kept, row], taken[:: max(1, len(taken) // RANGES)], [])


def _counts(rows: DataFrame, by: Order, bounds: list) -> dict[int, int]:
    """How many rows each range has: 2k + 1 is the k-th boundary's own key, even numbers lie between."""
    names = [f"k{i}" for i in range(len(by))]
    kind = ArrayType(StructType([StructField(n, rows.schema[c].dataType) for n, (c, _) in zip(names, by, strict=True)]))
    made = rows.sparkSession.createDataFrame([([tuple(b) for b in bounds], [tuple(b) for b in bounds[STRIDE - 1 :: STRIDE]])], StructType([StructField("fine", kind), StructField("coarse", kind)]))
    # Boundaries are values of one-row subqueries, so that plans stay short.
    keyed = rows.select(*[F.col(c).alias(n) for n, (c, _) in zip(names, by, strict=True)], made.select("fine").scalar().alias("fine"), made.select("coarse").scalar().alias("coarse"))
    mine = [F.col(n) for n in names]

    def passed(b: Column) -> Column:
        return _before([b[n] for n in names], mine, by)

    def step(b: Column) -> Column:
        return F.when(_before(mine, [b[n] for n in names], by), 0).when(passed(b), 2).otherwise(1)

    def near(p: Column) -> Column:
        # Coarse boundaries that lie wholly before the row tell where to look closer.
        return F.aggregate(F.slice("fine", p * STRIDE + 1, F.lit(STRIDE)), p * (2 * STRIDE), lambda a, b: a + step(b))

    counted = keyed.groupBy(let(F.size(F.filter("coarse", passed)), near).alias("r")).count()
    return dict(counted.collect())


def _between(rows: DataFrame, by: Order, bounds: list, first: int, last: int) -> DataFrame:
    """The rows of the ranges ``first`` to ``last``, by comparisons with two boundaries, of which the first column's reach the scan."""
    mine, out = [F.col(c) for c, _ in by], rows
    (name, up), top = by[0], rows.schema[by[0][0]].dataType
    if first > 0:
        low = bounds[(first - 1) // 2]
        keys = _literals(low, rows, by)
        out = out.filter(~_before(mine, keys, by) if first % 2 else _before(keys, mine, by))
        if low[0] is not None:
            edge = F.lit(low[0]).cast(top)
            out = out.filter((F.col(name) >= edge if up else F.col(name) <= edge) | F.col(name).isNull())
    if last < 2 * len(bounds):
        high = bounds[last // 2]
        keys = _literals(high, rows, by)
        out = out.filter(~_before(keys, mine, by) if last % 2 else _before(mine, keys, by))
        if high[0] is not None:
            edge = F.lit(high[0]).cast(top)
            out = out.filter(F.col(name) <= edge if up else F.col(name) >= edge)
    return out


def narrowed(rows: DataFrame, by: Order, skip: int, want: int, most: int = MOST) -> tuple[DataFrame, int]:
    """The rows of few ranges that hold places ``skip`` to ``skip + want`` of the order, and how many of them come before.

    They are at most ``most``, unless the page itself or the rows that agree in the whole order are more. ``rows`` has to be the same whenever it
    is read: a stored table, not a random choice.
    """
    total = rows.count()
    if skip >= total or want < 1:
        return rows.limit(0), 0
    while total > most:
        bounds = _bounds(rows, by, total)
        counts = _counts(rows, by, bounds)
        before, chosen = 0, []
        for r in sorted(counts):
            if before + counts[r] > skip and before < skip + want:
                chosen.append((r, before))
            before += counts[r]
        inside = sum(counts[r] for r, _ in chosen)
        skip -= chosen[0][1]
        rows = _between(rows, by, bounds, chosen[0][0], chosen[-1][0])
        # The page alone, or rows that all agree, can't be cut further.
        if inside == total or (len(chosen) == 1 and chosen[0][0] % 2):
            break
        total = inside
    return rows, skip


def page(rows: DataFrame, by: Order, number: int = 1, limit: int = 10, most: int = MOST, position: str | None = None) -> DataFrame:
    """``listing.page`` of the ordered rows, for any page; ``position`` names a column with the rows' places, from 1.

    A page past the end is empty. Rows that agree in all of ``by`` have an arbitrary order; let it end with a key.
    """
    if number < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    skip = (number - 1) * limit
    few, left = narrowed(rows, by, skip, limit, most)
    found = few.orderBy(*ordering(by)).offset(left).limit(limit)
    if position:
        # A window over a page's rows only.
        found = found.withColumn(position, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ordering(by))).cast("long") + skip)
    return found
