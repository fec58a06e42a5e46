"""Raw parking logs: one line per reading, one file per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.timeparts import ENGLISH_MONTHS, WEEKDAYS, token_number
from tallyloom.storage import small_side

SITE = r"^(.*?\)): "
FREE = r"\): (\d+) free parking @"
STAMP = r"@([A-Z][a-z]{2}) ([A-Z][a-z]{2}) (\d{2}) (\d{4}) (\d{2}:\d{2}:\d{2})"


def in_season(line: Column, year: int = 2016, months: tuple[str, ...] = ENGLISH_MONTHS[5:10]) -> Column:
    """Lines of one year that name one of the months."""
    named = F.lit(False)
    for m in months:
        named = named | line.contains(f" {m} ")
    return line.contains(f" {year} ") & named


def parse_log(lines: DataFrame, line: str = "value", year: int = 2016, **season) -> DataFrame:
    """Site, free places, weekday ``d1`` .. ``d7`` and local time of each in-season line."""
    text = F.col(line)
    kept = lines.filter(in_season(text, year, **season))

    def stamp(i: int) -> Column:
        return F.regexp_extract(text, STAMP, i)

    return kept.select(
        F.regexp_extract(text, SITE, 1).alias("site"),
        F.regexp_extract(text, FREE, 1).try_cast("int").alias("free"),
        F.concat(F.lit("d"), token_number(stamp(1), WEEKDAYS)).alias("weekday"),
        token_number(stamp(2), ENGLISH_MONTHS).alias("month"),
        stamp(3).try_cast("int").alias("day"),
        stamp(4).try_cast("int").alias("year"),
        stamp(5).alias("hour"),
    )


def read_logs(spark: SparkSession, paths: list[str], sites: DataFrame, **season) -> DataFrame:
    """All logs as one table; the code of a site comes from the site table."""
    return tag_sites(parse_log(spark.read.text(paths), **season), sites)


def tag_sites(readings: DataFrame, sites: DataFrame) -> DataFrame:
    """Attach code and area by site name; the site table is broadcast after a size check."""
    return readings.join(small_side(sites), "site", "left")


def positional(readings: DataFrame) -> DataFrame:
    """The prepared file's column order, ready for a headerless CSV."""
    two = [F.lpad(F.col(c).cast("string"), 2, "0").alias(c) for c in ("month", "day")]
    return readings.select(F.col("code").alias("name"), "free", "weekday", *two, "year", "hour")
