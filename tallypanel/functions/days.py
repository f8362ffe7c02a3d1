"""Days and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_LABEL = "MM-dd-yyyy"


def parse_day(text: Column, fmt: str = "yyyy-M-d", strict: bool = True) -> Column:
    """Text to date. Bad text fails the job, whatever the session's ANSI setting;
    ``strict=False`` gives NULL instead."""
    day = F.try_to_date(text, fmt)
    if not strict:
        return day
    bad = F.raise_error(F.concat(F.lit("no such day: "), text)).cast("date")
    return F.when(text.isNull() | day.isNotNull(), day).otherwise(bad)


def day_label(day: Column) -> Column:
    """Date to ``MM-dd-yyyy``."""
    return F.date_format(day, DAY_LABEL)


def previous_day(day: Column, days: int = 1) -> Column:
    return F.date_sub(day, days)


def local_time_label(utc: Column, zone: str = "Asia/Kolkata", suffix: str = "IST") -> Column:
    """UTC timestamp without zone to ``MM-dd-yyyy HH:mm`` in ``zone`` plus ``suffix``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.date_format(local, f"{DAY_LABEL} HH:mm'{suffix}'")


def run_time_label() -> Column:
    """The time the query runs, as ``local_time_label``."""
    now = F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
    return local_time_label(now)
