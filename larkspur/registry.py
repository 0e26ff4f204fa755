"""All registered queries with their SQL, by inventory name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import bridge
from larkspur.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the study's views. The SQL may use the views of bridge.SQL by name; without one the query is checked by tests alone."""

    def add(plan: Callable[[bridge.Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(bridge.views(ship(spark), sf_dir))
        if sql:
            body = sql.strip()
            ORACLE_SQL[name] = bridge.SQL + (", " + body[5:] if body[:5].upper() == "WITH " else body)
        return plan

    return add


def load() -> None:
    """Import every module of plans that registers queries."""
    from larkspur.plans import aggregates, checks, continuous, inference, languages, queue, records, relational, reports, rewriting, scalars, statistics, storage, stores, threads, transforms  # noqa: F401


load()
