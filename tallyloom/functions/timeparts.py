"""Post times, calendar parts and time keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month tokens of the post clock, in calendar order, and of log lines.
ITALIAN_MONTHS = ("gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic")
ENGLISH_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

POST_FORMAT = "HH:mm - dd MM yyyy"


def token_number(token: Column, names: tuple[str, ...], start: int = 1) -> Column:
    """Position of a token in a fixed name list, null when absent."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), token)
    return F.when(place > 0, place + F.lit(start - 1)).cast("int")


def normal_post_time(raw: Column, months: tuple[str, ...] = ITALIAN_MONTHS) -> Column:
    """``10:05 - 2 giu 2016`` to ``10:05 - 02 06 2016``; '' when no month is named."""
    token = F.regexp_extract(raw, "(" + "|".join(months) + ")", 1)
    day = F.regexp_extract(raw, r"- (\d{1,2}) ", 1)
    number = F.lpad(token_number(token, months).cast("string"), 2, "0")
    named = F.replace(raw, token, number)
    padded = F.when(F.length(day) == 1, F.regexp_replace(named, r"- (\d) ", "- 0$1 ")).otherwise(named)
    return F.when(raw.isNull() | (token == ""), F.lit("")).otherwise(padded)


def post_timestamp(text: Column, fmt: str = POST_FORMAT) -> Column:
    """Parsed time, null for anything the format does not accept."""
    return F.try_to_timestamp(text, F.lit(fmt))


def post_date(text: Column, fmt: str = POST_FORMAT) -> Column:
    return post_timestamp(text, fmt).cast("date")


def leading_hour(text: Column) -> Column:
    """First two signs as a number, null when they are none."""
    return F.substring(text, 1, 2).try_cast("int")


def hour_from_parts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Typed hour key."""
    return F.make_timestamp(year, month, day, hour, F.lit(0), F.lit(0))


def to_local(ts: Column, zone: str) -> Column:
    """Shift a UTC time to the clock of ``zone``."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def count_or_zero(cell: Column) -> Column:
    """Counter text, with the empty counter standing for 0.

    Signs that group the digits (``1.234``, ``1,234``, ``1 234``) are dropped; text that is no
    whole number gives null.
    """
    plain = F.regexp_replace(F.trim(cell), r"(?<=[0-9])[.,'\s\u00a0\u202f](?=[0-9]{3}(?![0-9]))", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("0")).try_cast("int")


def null_if_unknown(cell: Column, sentinel: str = "TimeNotAvailable") -> Column:
    return F.nullif(cell, F.lit(sentinel))
