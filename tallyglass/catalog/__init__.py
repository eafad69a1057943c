"""Registered queries: each pairs a Spark callable with the DuckDB SQL it must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AREAS = (
    "traffic", "notfound", "enrich", "journeys", "people", "experiments", "revenue",
    "diagnostics", "growth", "errors", "jobs", "streams",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without SQL the query is checked by tests alone."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
