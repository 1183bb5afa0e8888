"""Spatial partitioning: leaves of about equal load, and the partition of each object.

The partitioners work on the load of the cells of a grid, an array of fixed size whatever the number of objects, and give
rectangles of cells. Objects find their partition by their cell.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import spatial
from geostrata.functions.spatial import Grid

#: The partitions' loads may differ by this factor.
BALANCE = 1.2
LEAVES_PER_WORKER = 8


@dataclass(frozen=True)
class Leaf:
    """Cells from a first row and column up to those beyond, their load and their partition."""

    r0: int
    c0: int
    r1: int
    c1: int
    load: float
    partition: int = 0


def load_array(loads: DataFrame, grid: Grid, value: str = "objects") -> np.ndarray:
    """Loads (grid_row, grid_col, value) as an array; at most one row a cell reaches the driver."""
    out = np.zeros((grid.rows, grid.cols))
    for r in loads.select("grid_row", "grid_col", value).toLocalIterator():
        out[r[0], r[1]] += r[2]
    return out


def random_partition(partitions: int, key: str = "id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


class _Sums:
    """Loads of rectangles of cells in constant time."""

    def __init__(self, loads: np.ndarray):
        self.table = np.zeros((loads.shape[0] + 1, loads.shape[1] + 1))
        self.table[1:, 1:] = loads.cumsum(0).cumsum(1)

    def leaf(self, r0: int, c0: int, r1: int, c1: int) -> Leaf:
        t = self.table
        return Leaf(r0, c0, r1, c1, float(t[r1, c1] - t[r0, c1] - t[r1, c0] + t[r0, c0]))

    def quarters(self, x: Leaf) -> list[Leaf]:
        r, c = (x.r0 + x.r1) // 2, (x.c0 + x.c1) // 2
        return [self.leaf(*b) for b in ((x.r0, x.c0, r, c), (r, x.c0, x.r1, c), (x.r0, c, r, x.c1), (r, c, x.r1, x.c1)) if b[0] < b[2] and b[1] < b[3]]


def _packed(leaves: list[Leaf], partitions: int) -> list[Leaf]:
    """Leaves in their order, filled up into partitions of equal load."""
    total, done, out = sum(x.load for x in leaves), 0.0, []
    for x in leaves:
        p = min(partitions - 1, int((done + x.load / 2) / total * partitions)) if total else 0
        out.append(Leaf(x.r0, x.c0, x.r1, x.c1, x.load, p))
        done += x.load
    return out


def _spread(leaves: list[Leaf], partitions: int) -> list[Leaf]:
    """Leaves, the heaviest first, each to the partition with the least load so far."""
    heap = [(0.0, p) for p in range(partitions)]
    out = []
    for x in sorted(leaves, key=lambda x: (-x.load, x.r0, x.c0)):
        load, p = heapq.heappop(heap)
        out.append(Leaf(x.r0, x.c0, x.r1, x.c1, x.load, p))
        heapq.heappush(heap, (load + x.load, p))
    return out


def partition_loads(leaves: list[Leaf], partitions: int) -> list[float]:
    out = [0.0] * partitions
    for x in leaves:
        out[x.partition] += x.load
    return out


def quadtree(loads: np.ndarray, partitions: int) -> list[Leaf]:
    """Nodes are split while they exceed an eighth of a partition's share; leaves go to partitions in depth-first order."""
    sums = _Sums(loads)
    limit = loads.sum() / (LEAVES_PER_WORKER * partitions)
    out: list[Leaf] = []

    def visit(x: Leaf) -> None:
        parts = sums.quarters(x) if x.load > limit else []
        if len(parts) < 2:
            out.append(x)
        else:
            for y in parts:
                visit(y)

    visit(sums.leaf(0, 0, *loads.shape))
    return _packed(out, partitions)


def sort_tile(loads: np.ndarray, partitions: int) -> list[Leaf]:
    """The leaves of a sort-tile-recursive R-tree, eight for each partition: bands of rows of equal load, each cut into
    ranges of columns of equal load. Together they tile the domain, so no object needs a nearest leaf."""
    sums, n = _Sums(loads), LEAVES_PER_WORKER * partitions
    bands = max(1, round(np.sqrt(n)))

    def cuts(line: np.ndarray, k: int) -> list[int]:
        total = np.cumsum(line)
        if not total[-1]:
            return [0, len(line)]
        at = np.searchsorted(total, total[-1] * np.arange(1, k) / k) + 1
        return sorted({0, len(line), *np.minimum(at, len(line)).tolist()})

    out = []
    rows = cuts(loads.sum(1), bands)
    for a, b in zip(rows, rows[1:]):
        cols = cuts(loads[a:b].sum(0), -(-n // bands))
        out += [sums.leaf(a, c, b, d) for c, d in zip(cols, cols[1:])]
    return _packed(out, partitions)


def grid_cuts(loads: np.ndarray, partitions: int) -> list[Leaf]:
    """The heaviest rectangle is cut in two, along the line that parts its load most evenly, until there are enough."""
    sums = _Sums(loads)
    done: list[Leaf] = []
    heap: list[tuple[float, int, Leaf]] = [(-(root := sums.leaf(0, 0, *loads.shape)).load, 0, root)]
    made = 0
    while heap and len(done) + len(heap) < partitions:
        _, _, x = heapq.heappop(heap)
        ways = [(sums.leaf(x.r0, x.c0, k, x.c1), sums.leaf(k, x.c0, x.r1, x.c1)) for k in range(x.r0 + 1, x.r1)]
        ways += [(sums.leaf(x.r0, x.c0, x.r1, k), sums.leaf(x.r0, k, x.r1, x.c1)) for k in range(x.c0 + 1, x.c1)]
        if not ways or x.load < 1:
            done.append(x)
            continue
        for y in min(ways, key=lambda w: abs(w[0].load - w[1].load)):
            made += 1
            heapq.heappush(heap, (-y.load, made, y))
    rest = done + [x for _, _, x in sorted(heap, key=lambda h: h[1])]
    return [Leaf(x.r0, x.c0, x.r1, x.c1, x.load, p) for p, x in enumerate(rest)]


def load_quadtree(loads: np.ndarray, partitions: int, balance: float = BALANCE) -> list[Leaf]:
    """The heaviest node is split until the partitions' loads differ by no more than `balance`, or there are four nodes
    a partition. Loads may come from objects alone or from objects and queries (`plans.advisor.region_loads`)."""
    sums = _Sums(loads)
    heap: list[tuple[float, int, Leaf]] = [(-(root := sums.leaf(0, 0, *loads.shape)).load, 0, root)]
    done: list[Leaf] = []
    made = 0
    while True:
        leaves = _spread([*done, *(x for _, _, x in heap)], partitions)
        share = partition_loads(leaves, partitions)
        if (min(share) > 0 and max(share) <= balance * min(share)) or len(leaves) >= 4 * partitions or not heap:
            return leaves
        _, _, x = heapq.heappop(heap)
        parts = sums.quarters(x)
        if len(parts) < 2:
            done.append(x)
            continue
        for y in parts:
            made += 1
            heapq.heappush(heap, (-y.load, made, y))


PARTITIONERS = {"quadtree": quadtree, "r-tree": sort_tile, "grid": grid_cuts, "load.quadtree": load_quadtree}


def leaf_rows(leaves: list[Leaf], grid: Grid) -> list[dict]:
    return [asdict(x) | {k: getattr(grid.bounds(x.r0, x.c0), k) for k in ("lat_from", "lon_from")} | {"lat_to": grid.bounds(x.r1, x.c1).lat_from, "lon_to": grid.bounds(x.r1, x.c1).lon_from} for x in leaves]


def routed(objects: DataFrame, leaves: list[Leaf], grid: Grid) -> DataFrame:
    """Objects with the column `partition`; those outside of the domain have none and are left out.

    What is broadcast is the partition of each cell: as many rows as the grid has cells.
    """
    spark = objects.sparkSession
    cells = [((r << 16) + c, x.partition) for x in leaves for r in range(x.r0, x.r1) for c in range(x.c0, x.c1)]
    by_cell = spark.createDataFrame(cells, "__cell int, partition int")
    rows = objects.where(spatial.in_domain(F.col("lat"), F.col("lon"))).withColumn("__cell", grid.cell(F.col("lat"), F.col("lon")))
    return rows.join(F.broadcast(by_cell), "__cell").drop("__cell")


def laid_out(objects: DataFrame, leaves: list[Leaf], grid: Grid, partitions: int) -> DataFrame:
    """Objects shuffled so that each partition of the plan has whole spatial partitions."""
    return routed(objects, leaves, grid).repartition(partitions, "partition")


def partition_info(objects: DataFrame, leaves: list[Leaf], grid: Grid) -> DataFrame:
    """(partition, objects) of the partitions that have some."""
    return routed(objects, leaves, grid).groupBy("partition").agg(F.count("*").alias("objects"))


def save(spark: SparkSession, leaves: list[Leaf], grid: Grid, path: str) -> None:
    """Leaves as a table; any order of rows will do."""
    rows = [json.dumps(x | {"grid_rows": grid.rows, "grid_cols": grid.cols}) for x in leaf_rows(leaves, grid)]
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> tuple[list[Leaf], Grid]:
    rows = [json.loads(r[0]) for r in spark.read.text(path).toLocalIterator()]
    names = Leaf.__dataclass_fields__
    leaves = sorted((Leaf(**{k: r[k] for k in names}) for r in rows), key=lambda x: (x.partition, x.r0, x.c0))
    return leaves, Grid(rows[0]["grid_rows"], rows[0]["grid_cols"])


def tree_text(leaves: list[Leaf]) -> str:
    """Leaves by partition, one line each, for people."""
    by: dict[int, list[Leaf]] = defaultdict(list)
    for x in leaves:
        by[x.partition].append(x)
    return "\n".join(f"{p}: " + " ".join(f"[{x.r0},{x.c0})-[{x.r1},{x.c1}) {x.load:g}" for x in xs) for p, xs in sorted(by.items()))
