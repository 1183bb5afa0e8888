"""Rectangles, grid cells and quadtree nodes.

Rectangles are half-open: a point on the lower side is inside, one on the upper side isn't. Cells and nodes are half-open
as well, so each point of the domain is in one of them. Units are computed by one division and used the same way
everywhere, so rounding can't put a point and a rectangle's corner on different sides of a border.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.schema import LAT_MAX, LAT_MIN, LON_MAX, LON_MIN

MAX_LEVEL = 20


@dataclass(frozen=True)
class Rect:
    lat_from: float
    lon_from: float
    lat_to: float
    lon_to: float

    def __post_init__(self) -> None:
        for name in ("lat_from", "lon_from", "lat_to", "lon_to"):
            object.__setattr__(self, name, float(getattr(self, name)))

    def contains(self, lat: Column, lon: Column, closed: bool = False) -> Column:
        upper = (lat <= self.lat_to) & (lon <= self.lon_to) if closed else (lat < self.lat_to) & (lon < self.lon_to)
        return (lat >= self.lat_from) & (lon >= self.lon_from) & upper

    def overlaps(self, other: Rect) -> bool:
        return self.lat_from < other.lat_to and other.lat_from < self.lat_to and self.lon_from < other.lon_to and other.lon_from < self.lon_to

    def encloses(self, other: Rect) -> bool:
        return self.lat_from <= other.lat_from and self.lon_from <= other.lon_from and self.lat_to >= other.lat_to and self.lon_to >= other.lon_to

    def strictly_encloses(self, other: Rect) -> bool:
        return self.lat_from < other.lat_from and self.lon_from < other.lon_from and self.lat_to > other.lat_to and self.lon_to > other.lon_to

    @property
    def empty(self) -> bool:
        return not (self.lat_from < self.lat_to and self.lon_from < self.lon_to)


WORLD = Rect(LAT_MIN, LON_MIN, LAT_MAX, LON_MAX)


def in_domain(lat: Column, lon: Column) -> Column:
    """What lies outside belongs to no cell, node or partition."""
    return WORLD.contains(lat, lon)


@dataclass(frozen=True)
class Grid:
    """A grid over the domain; rows count along the latitude, columns along the longitude."""

    rows: int = 1000
    cols: int = 1000

    @property
    def lat_unit(self) -> float:
        return (LAT_MAX - LAT_MIN) / self.rows

    @property
    def lon_unit(self) -> float:
        return (LON_MAX - LON_MIN) / self.cols

    def row(self, lat: Column) -> Column:
        return F.floor((lat - LAT_MIN) / F.lit(self.lat_unit)).cast("int")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - LON_MIN) / F.lit(self.lon_unit)).cast("int")

    def key(self, row: Column, col: Column) -> Column:
        return F.shiftleft(row, 16) + col

    def cell(self, lat: Column, lon: Column) -> Column:
        return self.key(self.row(lat), self.col(lon))

    def place(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor((lat - LAT_MIN) / self.lat_unit), math.floor((lon - LON_MIN) / self.lon_unit)

    def span(self, r: Rect) -> tuple[int, int, int, int]:
        """First row and column, last row and column that a rectangle touches, its upper sides included."""
        return (*self.place(r.lat_from, r.lon_from), *self.place(r.lat_to, r.lon_to))

    def inside(self, r: Rect) -> tuple[int, int, int, int]:
        """First row and column, row and column beyond of the cells of which all points are in a rectangle.

        The cell of its lower corner isn't one of them unless the domain begins there: a greater number of the cell
        means a greater coordinate whatever the rounding, the same number doesn't.
        """
        a, b, c, d = self.span(r)
        first = lambda at, edge: 0 if edge else max(0, at + 1)
        return first(a, r.lat_from <= LAT_MIN), first(b, r.lon_from <= LON_MIN), min(c, self.rows), min(d, self.cols)

    def in_box(self, lat: Column, lon: Column, box: tuple[int, int, int, int]) -> Column:
        r0, c0, r1, c1 = box
        row, col = self.row(lat), self.col(lon)
        return (row >= r0) & (row < r1) & (col >= c0) & (col < c1)

    def bounds(self, row: int, col: int) -> Rect:
        a, b = LAT_MIN + row * self.lat_unit, LON_MIN + col * self.lon_unit
        return Rect(a, b, a + self.lat_unit, b + self.lon_unit)

    def with_bounds(self, df: DataFrame, key: str = "cell") -> DataFrame:
        """The rectangle of each cell key."""
        lat = F.lit(LAT_MIN) + F.shiftright(F.col(key), 16) * F.lit(self.lat_unit)
        lon = F.lit(LON_MIN) + F.col(key).bitwiseAND(F.lit(65535)) * F.lit(self.lon_unit)
        return df.select("*", lat.alias("lat_from"), lon.alias("lon_from"), (lat + F.lit(self.lat_unit)).alias("lat_to"), (lon + F.lit(self.lon_unit)).alias("lon_to"))

    def cells(self, rects: DataFrame, which: str = "all") -> DataFrame:
        """One row for each cell (grid_row, grid_col, cell) that a rectangle touches; `which`: all, border or inside.

        Only numbers of rows and columns are generated, within the plan; nothing is listed on the driver.
        """
        r0, c0, r1, c1 = self.row(F.col("lat_from")), self.col(F.col("lon_from")), self.row(F.col("lat_to")), self.col(F.col("lon_to"))
        spans = rects.withColumns({"__r0": r0, "__c0": c0, "__r1": r1, "__c1": c1}).where("__r0 <= __r1 and __c0 <= __c1")
        out = spans.withColumn("grid_row", F.explode(F.sequence("__r0", "__r1"))).withColumn("grid_col", F.explode(F.sequence("__c0", "__c1")))
        on_border = F.col("grid_row").isin(F.col("__r0"), F.col("__r1")) | F.col("grid_col").isin(F.col("__c0"), F.col("__c1"))
        if which != "all":
            out = out.where(on_border if which == "border" else ~on_border)
        return out.withColumn("cell", self.key(F.col("grid_row"), F.col("grid_col"))).drop("__r0", "__c0", "__r1", "__c1")


def node_id(level: int, row: Column | int, col: Column | int) -> Column | int:
    """The number of a quadtree node: its level, row and column, twenty bits each for the latter two."""
    if isinstance(row, int):
        return (level << 40) + (row << 20) + col
    return F.lit(level << 40) + F.shiftleft(row.cast("bigint"), 20) + col.cast("bigint")


def quadtree_node(lat: Column, lon: Column, level: int) -> Column:
    """The node of a level that holds a point."""
    g = Grid(1 << level, 1 << level)
    return node_id(level, g.row(lat), g.col(lon))


def nodes_above(leaf: Column, depth: int) -> Column:
    """The nodes of all levels down to `depth` that hold a node of that level, itself included, as an array."""
    row, col = (F.shiftright(leaf, by).bitwiseAND(F.lit((1 << MAX_LEVEL) - 1)) for by in (20, 0))
    return F.array(*(node_id(lv, F.shiftright(row, depth - lv), F.shiftright(col, depth - lv)) for lv in range(depth + 1)))


def node_parts(node: int) -> tuple[int, int, int]:
    return node >> 40, (node >> 20) & ((1 << 20) - 1), node & ((1 << 20) - 1)


def node_bounds(node: int) -> Rect:
    level, row, col = node_parts(node)
    return Grid(1 << level, 1 << level).bounds(row, col)


def is_node_ancestor(upper: int, lower: int) -> bool:
    """Whether `lower` is another node within `upper`."""
    (a, r, c), (b, s, d) = node_parts(upper), node_parts(lower)
    return a < b and s >> (b - a) == r and d >> (b - a) == c


def quadrant(lat: Column, lon: Column, r: Rect) -> Column:
    """Which child of a node (0 to 3) holds a point: 1 for the upper half of the latitude, 2 for that of the longitude."""
    return F.when(lat < (r.lat_from + r.lat_to) / 2, 0).otherwise(1) + F.when(lon < (r.lon_from + r.lon_to) / 2, 0).otherwise(2)


def overlap_kind(query: Rect, node: Rect) -> str:
    """How a query covers a node: whole, a half (south, north, west, east), a corner (south-west, …), inner where it lies
    within the node or crosses it, or none."""
    if query.encloses(node):
        return "whole"
    if not query.overlaps(node):
        return "none"
    south, north = query.lat_from <= node.lat_from, query.lat_to >= node.lat_to
    west, east = query.lon_from <= node.lon_from, query.lon_to >= node.lon_to
    lat = "" if south and north else "south" if south else "north" if north else None
    lon = "" if west and east else "west" if west else "east" if east else None
    return "inner" if lat is None or lon is None else "-".join(x for x in (lat, lon) if x)


def cover(r: Rect, level: int) -> tuple[list[int], tuple[int, int, int, int]]:
    """The fewest nodes down to `level` that tile the nodes of that level inside of a rectangle, and the box of these
    (see `Grid.inside`). Their number grows with the side of the rectangle in nodes, not with its area."""
    r0, c0, r1, c1 = box = Grid(1 << level, 1 << level).inside(r)
    if r0 >= r1 or c0 >= c1:
        return [], box
    out: list[int] = []

    def visit(lv: int, row: int, col: int) -> None:
        size = 1 << (level - lv)
        a, b = row * size, col * size
        if a >= r1 or b >= c1 or a + size <= r0 or b + size <= c0:
            return
        if a >= r0 and b >= c0 and a + size <= r1 and b + size <= c1:
            out.append(node_id(lv, row, col))
            return
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            visit(lv + 1, 2 * row + i, 2 * col + j)

    visit(0, 0, 0)
    return out, box
