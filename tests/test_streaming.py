"""Streamed buckets equal batch buckets once the watermark has passed them."""

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import cleaning
from tallyloom.storage import scratch_path
from tallyloom.streaming import buckets

SCHEMA = "series string, ts timestamp, value double"


def source(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], start + datetime.timedelta(minutes=17 * i), float(i)) for i in range(400)]
    path = scratch_path(spark, "stream")
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(path)
    return df, path


def run(spark, build):
    df, path = source(spark)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    out = scratch_path(spark, "out")
    query = buckets.write_buckets(build(stream), out, scratch_path(spark, "cp"))
    assert query.awaitTermination(120)
    return df, spark.read.parquet(out)


def test_means(spark):
    df, got = run(spark, lambda s: buckets.means_per_bucket(s, ["series"], "ts", "value"))
    want = {(r["series"], r["ts"]): r["value"] for r in cleaning.mean_per_hour(df, ["series"], "ts", "value").collect()}
    rows = got.collect()
    assert len(rows) > 150
    assert all(want[r["series"], r["ts"]] == r["value"] for r in rows)


def test_counts(spark):
    df, got = run(spark, lambda s: buckets.counts_per_bucket(s, ["series"], "ts"))
    want = {(r["series"], r["d"]): r["count"] for r in df.groupBy("series", F.date_trunc("day", "ts").alias("d")).count().collect()}
    rows = got.collect()
    assert len(rows) >= 6
    assert all(want[r["series"], r["ts"]] == r["n"] for r in rows)
