"""Session settings the analyses rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "tallyloom", cores: str | int = "*", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    parts = "8" if cores == "*" else str(max(int(cores), 2))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def pin(spark: SparkSession) -> SparkSession:
    """Dates and hours are cut in UTC, whatever the zone of the driver machine."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
