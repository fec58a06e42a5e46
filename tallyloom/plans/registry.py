"""Where the query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def steady(value, places: int = 6):
    """Rounded for comparison. Two engines sum in different orders, so the last digits
    are cut by a decimal first; a value that ends in 5 then rounds the same way in both."""
    cell = F.col(value) if isinstance(value, str) else value
    return F.round(cell.try_cast("decimal(28,9)"), places).cast("double")


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a function of :class:`Tables`; ``sql`` is its comparison text, if one exists."""

    def enter(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return enter


def oracle_texts() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in ORACLES.items()}
