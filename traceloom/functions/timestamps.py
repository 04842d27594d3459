"""Timestamp grammar and FILETIME expressions; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILETIME_EPOCH = 116_444_736_000_000_000  # 1970-01-01 in 100 ns ticks since 1601
MAX_EXCEL_SERIAL = 73050


def normalize_timestamp(raw: Column) -> Column:
    """TIMESTAMP of ISO, US, 12-hour, month-name, Unix (10 or 13 digits) and spreadsheet-serial spellings; null if none fits.

    Every branch is gated by its shape, so digits are never cast to a year.
    """
    x = F.trim(raw)
    plain = F.regexp_replace(x, r"(\d{1,2})(st|nd|rd|th)\b", "$1")
    fmt = lambda c, f: F.try_to_timestamp(c, F.lit(f))
    us = F.coalesce(fmt(x, "M/d/yyyy h:mm:ss a"), fmt(x, "M/d/yyyy h:mm a"), fmt(x, "M/d/yyyy H:mm:ss"), fmt(x, "M/d/yyyy H:mm"), fmt(x, "M/d/yyyy"))
    named = F.coalesce(*[fmt(plain, f) for f in ("MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy H:mm:ss", "MMM d, yyyy H:mm:ss", "d MMM yyyy H:mm:ss")])
    number = x.try_cast("double")
    serial = F.timestamp_seconds((number - 25569) * 86400)
    return (
        F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), x.try_cast("timestamp"))
        .when(x.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), us)
        .when(x.rlike(r"^[A-Za-z]{3,9} \d{1,2}|^\d{1,2}(st|nd|rd|th)? [A-Za-z]{3}"), named)
        .when(x.rlike(r"^\d{10}$"), F.timestamp_seconds(x.try_cast("long")))
        .when(x.rlike(r"^\d{13}$"), F.timestamp_millis(x.try_cast("long")))
        .when(x.rlike(r"^\d{1,5}(\.\d+)?$") & number.between(1, MAX_EXCEL_SERIAL), serial)
    )


def extract_date(raw: Column) -> Column:
    return F.date_format(normalize_timestamp(raw), "yyyy-MM-dd")


def extract_minute(raw: Column) -> Column:
    return F.date_format(normalize_timestamp(raw), "yyyy-MM-dd HH:mm")


def filetime_string(ticks: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss.fffffff` of a FILETIME; '' for zero and for times before 1970."""
    since = ticks - FILETIME_EPOCH
    at = F.timestamp_micros(F.call_function("div", since, F.lit(10)))
    text = F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.pmod(since, F.lit(10)).cast("string"))
    return F.when(since >= 0, text).otherwise("")


def zero_subsecond(ticks: Column) -> Column:
    return (ticks != 0) & (F.pmod(ticks, F.lit(10_000_000)) == 0)
