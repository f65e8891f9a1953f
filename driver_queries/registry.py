"""Registration of driver queries: a Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driver_queries import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WITH_L = f"WITH l AS MATERIALIZED ({T.LISTINGS})"
WITH_LE = f"{WITH_L}, e AS MATERIALIZED ({T.ESTIMATES_OF_L})"
MERC_X = "6378137.0e0 * radians({0})"
MERC_Y = "6378137.0e0 * ln(tan(pi() / 4 + radians({0}) / 2))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
