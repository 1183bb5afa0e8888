"""From a query to the DataFrame that answers it from the objects themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions import texts
from geostrata.operators import aggregate
from geostrata.plans.query import WarehouseQuery


def predicate(q: WarehouseQuery) -> Column:
    """All of a query's predicates on an object but that on the interval. Comparisons stay on bare columns (the day
    becomes a comparison of the time), so that they reach the files' statistics."""
    out = F.lit(True)
    if q.range is not None:
        out &= q.range.contains(F.col("lat"), F.col("lon"), q.closed)
    if q.after is not None:
        out &= F.col("ts") >= F.lit(q.after.isoformat()).cast("timestamp")
    if q.topic is not None:
        out &= F.col("topic") == q.topic
    if q.keywords:
        out &= texts.contains_all(F.col("text"), q.keywords)
    return out


def selected(objects: DataFrame, q: WarehouseQuery) -> DataFrame:
    """The objects that a query is about. An interval counts back from the latest object."""
    rows = objects.where(predicate(q))
    if q.interval:
        latest = objects.agg(F.max("ts").alias("__latest"))
        rows = rows.crossJoin(F.broadcast(latest)).where(F.col("ts") > F.col("__latest") - F.expr(f"interval {int(q.interval)} minutes")).drop("__latest")
    return rows


def ordered(result: DataFrame, q: WarehouseQuery) -> DataFrame:
    if q.order is None or q.measure != "count":
        return result
    by = F.asc("cnt") if q.order == "asc" else F.desc("cnt")
    return result.orderBy(by, *(F.asc(x) for x in q.levels))


def execute(objects: DataFrame, q: WarehouseQuery) -> DataFrame:
    """(levels …, cnt) or (levels …, term, freq, rnk)."""
    rows = selected(objects, q)
    if q.measure == "topk":
        return aggregate.topk(rows, q.group, q.k)
    return ordered(aggregate.count(rows, q.group), q)


class NaiveExecutor:
    """Answers from the objects. The executors of `plans.cubes` have the same interface."""

    def __init__(self, objects: DataFrame):
        self.objects = objects

    def execute(self, q: WarehouseQuery) -> DataFrame:
        return execute(self.objects, q)
