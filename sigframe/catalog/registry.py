"""Registry of runnable queries: a name, a callable over a table folder, and the oracle's SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, survey_id: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        SURVEY_IDS[name] = survey_id
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r6(c: Column, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)
