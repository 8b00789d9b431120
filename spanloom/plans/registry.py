"""Registry of the runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans.oracle_tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    """Register a query; ``sql`` runs on the fixture tables named in ``needs``."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(needs or [], sql)
        return fn

    return wrap
