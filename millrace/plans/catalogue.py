"""The query catalogue of the core engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import listings, ordered, projects, records, relations, storage, texts, workflows  # noqa: F401  (they register their queries)
from millrace.plans.registry import PLANS, SQL, runnable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(plan) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
