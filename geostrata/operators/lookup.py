"""Lookups of objects: by words, time buckets, cells, nodes, and all of these together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions import texts
from geostrata.functions.spatial import Grid, Rect, in_domain, quadtree_node
from geostrata.functions.stopwords import STOPWORDS

_STOP = frozenset(STOPWORDS)


def search_words(words: tuple[str, ...]) -> tuple[str, ...]:
    """Words to look for: in lower case, each once, without stop words."""
    return tuple(dict.fromkeys(w for w in map(str.lower, words) if w not in _STOP))


def postings(objects: DataFrame) -> DataFrame:
    """(term, id): the inverted index, without stop words. Written with `partitionBy` or sorted by term it serves many
    lookups."""
    return objects.select(F.explode(texts.folded_tags(F.col("text"))).alias("term"), "id").where(~F.col("term").isin(*STOPWORDS))


def ids_with_words(index: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(id) of the objects that have all words; none if only stop words are asked for."""
    wanted = search_words(words)
    hits = index.where(F.col("term").isin(*wanted)) if wanted else index.where(F.lit(False))
    return hits.groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select("id")


def with_words(objects: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """The same without an index: a filter on the objects."""
    wanted = search_words(words)
    return objects.where(texts.contains_all(F.col("text"), wanted) if wanted else F.lit(False))


def between_hours(first: str | int, last: str | int) -> Column:
    """Objects of the hours from first to last (yyyyMMddHH), both included, as a comparison of times."""
    bound = lambda x: F.to_timestamp(F.lit(str(x)), "yyyyMMddHH")
    return (F.col("ts") >= bound(first)) & (F.col("ts") < bound(last) + F.expr("interval 1 hour"))


def find(objects: DataFrame, rect: Rect | None = None, words: tuple[str, ...] | None = None, hours: tuple[str | int, str | int] | None = None) -> DataFrame:
    """Objects by any of rectangle, words and hours together. All become one filter."""
    parts = [rect.contains(F.col("lat"), F.col("lon"))] if rect else []
    parts += [between_hours(*hours)] if hours else []
    rows = objects.where(reduce(lambda a, b: a & b, parts)) if parts else objects
    return rows if words is None else with_words(rows, words)


def in_cell(objects: DataFrame, grid: Grid, row: int, col: int, hour: str | int | None = None) -> DataFrame:
    """Objects of one grid cell, of one hour or all. The cell's rectangle, a little widened, goes first: it reaches the
    files' statistics, and the exact test of the cell follows."""
    r = grid.bounds(row, col)
    near = Rect(r.lat_from - 1e-6, r.lon_from - 1e-6, r.lat_to + 1e-6, r.lon_to + 1e-6)
    lat, lon = F.col("lat"), F.col("lon")
    rows = objects.where(near.contains(lat, lon) & in_domain(lat, lon) & (grid.row(lat) == row) & (grid.col(lon) == col))
    return rows if hour is None else rows.where(between_hours(hour, hour))


def in_leaves(objects: DataFrame, level: int, rect: Rect, checked: tuple[int, ...] = ()) -> DataFrame:
    """Objects of a rectangle by quadtree leaf (column `node`), without the leaves that were answered before."""
    rows = objects.where(rect.contains(F.col("lat"), F.col("lon"))).withColumn("node", quadtree_node(F.col("lat"), F.col("lon"), level))
    return rows.where(~F.col("node").isin(*checked)) if checked else rows
