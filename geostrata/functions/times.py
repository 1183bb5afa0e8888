"""Parts of a time and the way from finer to coarser ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERNS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH"}


def week_of_year(date: Column) -> Column:
    """The week of the US calendar: weeks begin on Sunday and 1 January is in week 1, so the Saturday that ends a week
    tells its number."""
    saturday = F.date_add(date, 7 - F.dayofweek(date))
    return F.ceil(F.dayofyear(saturday) / 7).cast("int")


def week_key(date: Column) -> Column:
    """Calendar year and week; the last days of December may be in week 1 and keep their own year."""
    return F.concat(F.date_format(date, "yyyy"), week_of_year(date).cast("string"))


def part(ts: Column, level: str) -> Column:
    """The key of a time at a level: yyyy, yyyyMM, yyyyMMdd, yyyyMMddHH, or the week."""
    return week_key(F.to_date(ts)) if level == "week" else F.date_format(ts, _PATTERNS[level])


def rolled_up(key: Column, fine: str, coarse: str) -> Column:
    """The key at a coarser level of a key of hours or days."""
    if fine == coarse:
        return key
    if fine not in ("hour", "day") or coarse not in ("day", "week", "month", "year"):
        raise ValueError(f"{coarse} doesn't follow from {fine}")
    if coarse == "week":
        return week_key(F.to_date(F.substring(key, 1, 8), "yyyyMMdd"))
    return F.substring(key, 1, {"year": 4, "month": 6, "day": 8}[coarse])


def now_text() -> Column:
    """The current time with tenths of a second."""
    return F.substring(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS"), 1, 21)
