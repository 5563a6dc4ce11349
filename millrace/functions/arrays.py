"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, though lambdas inside ``body`` use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(words: Column, n: int, sep: str = " ") -> Column:
    """The distinct runs of n successive elements, joined; none if there are fewer."""
    none = F.array().cast("array<string>")

    def runs(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) < n, none).otherwise(F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(w, i, F.lit(n)), sep))))

    return let(words, runs)


def put(pairs: Column, key: Column, value: Column) -> Column:
    """The map with one entry set."""
    return F.map_concat(F.map_filter(pairs, lambda k, _: k != key), F.create_map(key, value))


def compact_map(values: Column, body: Callable[[Column], Column]) -> Column:
    """The results of ``body`` that aren't null."""
    return F.array_compact(F.transform(values, body))
