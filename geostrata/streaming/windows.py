"""Counts of the last n minutes, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators import aggregate
from geostrata.schema import levels_of

#: How late an object may be.
LATENESS = "10 hours"


def sliding(objects: DataFrame, minutes: int, step: int, group: str, lateness: str = LATENESS) -> DataFrame:
    """(window_end, levels …, cnt) for every step, of a stream or a table: the objects of the n minutes before."""
    rows = objects.withWatermark("ts", lateness) if objects.isStreaming else objects
    counted = rows.groupBy(F.window("ts", f"{minutes} minutes", f"{step} minutes").alias("w"), *levels_of(group)).agg(F.count("*").alias("cnt"))
    return counted.select(F.col("w.end").alias("window_end"), *levels_of(group), "cnt")


def tumbling(objects: DataFrame, minutes: int, group: str, lateness: str = LATENESS) -> DataFrame:
    """(window_start, levels …, cnt): base windows, each object in one of them."""
    rows = objects.withWatermark("ts", lateness) if objects.isStreaming else objects
    counted = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), *levels_of(group)).agg(F.count("*").alias("cnt"))
    return counted.select(F.col("w.start").alias("window_start"), *levels_of(group), "cnt")


def rolling(base: DataFrame, base_minutes: int, windows: int, group: str) -> DataFrame:
    """The sum over the last base windows at each of them: state holds base windows only, however long the interval."""
    levels = levels_of(group)
    seconds = F.col("window_start").cast("long")
    span = Window.partitionBy(*levels).orderBy(seconds).rangeBetween(-(windows - 1) * base_minutes * 60, 0)
    return base.select((F.col("window_start") + F.expr(f"interval {base_minutes} minutes")).alias("window_end"), *levels, F.sum("cnt").over(span).alias("cnt"))


def coarser(base: DataFrame, minutes: int, group: str) -> DataFrame:
    """Base windows merged into longer ones, of a whole number of base windows."""
    merged = base.withColumn("window_start", F.window("window_start", f"{minutes} minutes")["start"])
    return aggregate.merged_counts(merged, ("window_start", *levels_of(group)))
