"""Retention: only the latest hours are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hours of data that are kept.
HOURS = 10


def latest_hours(objects: DataFrame, hours: int = HOURS) -> DataFrame:
    """Objects of the latest distinct hours that there are. The hours come from the data, not from the clock, so a late
    object of a dropped hour is dropped as well. Only as many rows as hours are broadcast."""
    hour = F.date_trunc("hour", "ts").alias("__hour")
    kept = objects.select(hour).where("__hour is not null").distinct().orderBy(F.desc("__hour")).limit(hours)
    return objects.join(F.broadcast(kept), F.date_trunc("hour", F.col("ts")) == F.col("__hour"), "left_semi")


def without_hour(objects: DataFrame, hour: str | int) -> DataFrame:
    return objects.where(F.col("hour") != str(hour))
