"""Null handling and time grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in the columns (all by default); text left over is never null."""
    return df.na.drop("any", subset=columns).na.fill("")


def bounds_of(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))


def time_grid(df: DataFrame, keys: list[str], ts: str, step: str) -> DataFrame:
    """Every step from the first to the last time of each key, with its position ``pos``."""
    span = F.sequence("_first", "_last", F.expr(f"INTERVAL {step}"))
    return bounds_of(df, keys, ts).select(*keys, F.posexplode(span).alias("pos", ts))


def on_grid(df: DataFrame, keys: list[str], ts: str, value: str, step: str, fill: float | None = None) -> DataFrame:
    """One row per key and step; a missing step gets ``fill`` (null by default).

    The input holds at most one row per key and step.
    """
    full = time_grid(df, keys, ts, step).join(df.select(*keys, ts, value), [*keys, ts], "left")
    v = F.col(value).cast("double")
    return full.select(*keys, "pos", ts, (v if fill is None else F.coalesce(v, F.lit(float(fill)))).alias(value))


def gaps(df: DataFrame, keys: list[str], ts: str, step: str) -> DataFrame:
    """Steps inside the covered span that have no row."""
    return time_grid(df, keys, ts, step).drop("pos").join(df.select(*keys, ts), [*keys, ts], "left_anti")


def between(df: DataFrame, ts: str, start: str | Column, end: str | Column) -> DataFrame:
    """Rows from start to end, both included."""
    lo = F.lit(start) if isinstance(start, str) else start
    hi = F.lit(end) if isinstance(end, str) else end
    kind = dict(df.dtypes)[ts]
    return df.filter(F.col(ts).between(lo.cast(kind), hi.cast(kind)))


def mean_per_hour(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Mean per key and hour."""
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("ts")).agg(F.avg(value).alias(value))


def mean_per_day(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Mean per key and day."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(value).alias(value))
