"""Counts and means per key and time bucket over Structured Streaming.

An extension: the same daily counts and hourly means as in batch, for input
that keeps arriving. Buckets close when the watermark passes their end, so the
state holds open buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_per_bucket(stream: DataFrame, keys: list[str], ts: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(keys, ts, n): rows per key and bucket, ``ts`` being the bucket start."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("_w.start").alias("ts"), "n")


def means_per_bucket(
    stream: DataFrame, keys: list[str], ts: str, value: str, width: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """(keys, ts, value): mean per key and bucket."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), *keys)
    return grouped.agg(F.avg(value).alias(value)).select(*keys, F.col("_w.start").alias("ts"), value)


def write_buckets(buckets: DataFrame, path: str, checkpoint: str):
    """Append closed buckets as Parquet; the checkpoint folder makes a restart resume."""
    return (
        buckets.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
