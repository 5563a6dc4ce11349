"""Registered queries: a plan over the tables and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table

Plan = Callable[[Callable[[str], DataFrame]], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; it gets a function from table names to frames."""

    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def runnable(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(lambda name: table(spark, folder, name))
