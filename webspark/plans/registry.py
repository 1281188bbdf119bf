"""Registry of queries and of the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_importable
from ..sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of tables under its name; ``sql`` is its oracle."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(*(read(spark, sf_dir, t) for t in tables))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
