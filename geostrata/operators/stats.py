"""Statistics of regions and workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions import spatial
from geostrata.functions.spatial import Grid
from geostrata.operators.aggregate import raised
from geostrata.schema import levels_of


def objects_by_cell(objects: DataFrame, grid: Grid) -> DataFrame:
    """(grid_row, grid_col, objects) of the cells that have some; the domain only."""
    rows = objects.where(spatial.in_domain(F.col("lat"), F.col("lon")))
    return rows.groupBy(grid.row(F.col("lat")).alias("grid_row"), grid.col(F.col("lon")).alias("grid_col")).agg(F.count("*").alias("objects"))


def objects_by_node(objects: DataFrame, depth: int) -> DataFrame:
    """(node, objects) on all levels down to `depth`, the upper ones summed from the leaves."""
    rows = objects.where(spatial.in_domain(F.col("lat"), F.col("lon")))
    leaves = rows.groupBy(spatial.quadtree_node(F.col("lat"), F.col("lon"), depth).alias("node")).agg(F.count("*").alias("objects"))
    return raised(leaves, depth, "objects")


def cardinality(objects: DataFrame, group: str, grid: Grid, approximate: bool = False) -> DataFrame:
    """(cell, objects, keys): distinct keys of a grouping in each cell. Exact by two aggregations, or by a sketch."""
    placed = objects.where(spatial.in_domain(F.col("lat"), F.col("lon"))).withColumn("cell", grid.cell(F.col("lat"), F.col("lon")))
    levels = levels_of(group)
    if approximate and levels:
        return placed.groupBy("cell").agg(F.count("*").alias("objects"), F.approx_count_distinct(F.struct(*levels)).alias("keys"))
    keyed = placed.groupBy("cell", *levels).agg(F.count("*").alias("n"))
    return keyed.groupBy("cell").agg(F.sum("n").alias("objects"), F.count("*").alias("keys"))


def cell_mean_std(objects: DataFrame, grid: Grid) -> DataFrame:
    """One row: cells, mean and population standard deviation of the objects of all cells, empty ones included."""
    per = objects_by_cell(objects, grid).agg(F.coalesce(F.sum("objects"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("objects") * F.col("objects")), F.lit(0)).alias("ss"))
    n = F.lit(grid.rows * grid.cols)
    mean = F.col("s") / n
    return per.select(n.cast("bigint").alias("cells"), mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / n - mean * mean, F.lit(0.0))).alias("std"))


def busiest_hour(objects: DataFrame) -> DataFrame:
    """The hour with the most objects, the earliest of several: (hour, objects)."""
    return objects.groupBy("hour").agg(F.count("*").alias("objects")).orderBy(F.desc("objects"), "hour").limit(1)


def index_info(objects: DataFrame, depth: int) -> DataFrame:
    """(hour, leaves, objects, largest) of the quadtree of each hour at a depth."""
    rows = objects.where(spatial.in_domain(F.col("lat"), F.col("lon")))
    leaves = rows.groupBy("hour", spatial.quadtree_node(F.col("lat"), F.col("lon"), depth).alias("node")).agg(F.count("*").alias("n"))
    return leaves.groupBy("hour").agg(F.count("*").alias("leaves"), F.sum("n").alias("objects"), F.max("n").alias("largest"))


def drawing(objects: DataFrame, hour: str, depth: int) -> DataFrame:
    """(node, lat_from, lon_from, lat_to, lon_to, id, lat, lon): the leaves of an hour with their objects."""
    g = Grid(1 << depth, 1 << depth)
    rows = objects.where((F.col("hour") == hour) & spatial.in_domain(F.col("lat"), F.col("lon")))
    rows = rows.select(spatial.quadtree_node(F.col("lat"), F.col("lon"), depth).alias("node"), g.cell(F.col("lat"), F.col("lon")).alias("cell"), "id", "lat", "lon")
    return g.with_bounds(rows).select("node", "lat_from", "lon_from", "lat_to", "lon_to", "id", "lat", "lon")


def hours(objects: DataFrame) -> DataFrame:
    """(hour, objects) of all hours."""
    return objects.groupBy("hour").agg(F.count("*").alias("objects"))


def objects_to_check(objects: DataFrame, queries: DataFrame, grid: Grid) -> DataFrame:
    """(query_id, objects) of the cells along the border of each query: what it has to look at one by one."""
    border = grid.cells(queries, "border").select("query_id", "grid_row", "grid_col")
    return border.join(objects_by_cell(objects, grid), ["grid_row", "grid_col"]).groupBy("query_id").agg(F.sum("objects").alias("objects"))
