"""Views of chosen places only, as the advisor picks them: (cell or node, grouping). A query takes what is there place by
place; everything else within its range is answered from the objects."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import spatial
from geostrata.functions.spatial import Grid
from geostrata.operators import aggregate
from geostrata.plans import executor
from geostrata.plans.query import WarehouseQuery
from geostrata.schema import DIMENSIONS, GROUPS, NONE, is_ancestor, levels_of

_BY_ID = {aggregate.id_of(g): g for g in GROUPS}
#: Of each place, the groupings that it has views of and their rows. As many entries as views, so the advisor's budget
#: bounds it.
Chosen = dict[int, dict[str, int]]


class GridPlaces:
    """Places are the cells of a grid."""

    def __init__(self, grid: Grid):
        self.grid = grid

    def placed(self, objects: DataFrame, wanted: DataFrame) -> DataFrame:
        """Objects with each of the wanted places that holds them."""
        lat, lon = F.col("lat"), F.col("lon")
        rows = objects.where(spatial.in_domain(lat, lon)).withColumn("place", self.grid.cell(lat, lon).cast("bigint"))
        return rows.join(F.broadcast(wanted), "place")

    def without(self, objects: DataFrame, used: list[int]) -> DataFrame:
        lat, lon = F.col("lat"), F.col("lon")
        cell = F.when(spatial.in_domain(lat, lon), self.grid.cell(lat, lon).cast("bigint"))
        return objects.join(F.broadcast(_listed(objects.sparkSession, used)), cell == F.col("place"), "left_anti")

    def usable(self, q: WarehouseQuery, have: Iterable[int]) -> list[int]:
        """The places with a view that lie within the query's range."""
        r0, c0, r1, c1 = self.grid.inside(q.range or spatial.WORLD)
        return [p for p in have if r0 <= p >> 16 < r1 and c0 <= p & 65535 < c1]


class NodePlaces:
    """Places are quadtree nodes of all levels down to one. Of nodes within each other a query takes the largest."""

    def __init__(self, depth: int):
        self.depth = depth

    def _node(self, level: int):
        lat, lon = F.col("lat"), F.col("lon")
        return F.when(spatial.in_domain(lat, lon), spatial.quadtree_node(lat, lon, level))

    def placed(self, objects: DataFrame, wanted: DataFrame) -> DataFrame:
        nodes = F.array(*(self._node(lv) for lv in range(self.depth + 1)))
        return objects.withColumn("place", F.explode(nodes)).join(F.broadcast(wanted), "place")

    def without(self, objects: DataFrame, used: list[int]) -> DataFrame:
        by_level = defaultdict(list)
        for p in used:
            by_level[spatial.node_parts(p)[0]].append(p)
        spark = objects.sparkSession
        return reduce(lambda rows, x: rows.join(F.broadcast(_listed(spark, x[1])), self._node(x[0]) == F.col("place"), "left_anti"), sorted(by_level.items()), objects)

    def usable(self, q: WarehouseQuery, have: Iterable[int]) -> list[int]:
        r0, c0, r1, c1 = Grid(1 << self.depth, 1 << self.depth).inside(q.range or spatial.WORLD)
        taken: set[int] = set()
        for p in sorted(have):  # upper levels first
            level, row, col = spatial.node_parts(p)
            size = 1 << (self.depth - level)
            inside = r0 <= row * size and (row + 1) * size <= r1 and c0 <= col * size and (col + 1) * size <= c1
            if inside and not any(spatial.node_id(lv, row >> (level - lv), col >> (level - lv)) in taken for lv in range(level)):
                taken.add(p)
        return sorted(taken)


def _listed(spark: SparkSession, places: list[int]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in places], "place bigint")


@dataclass
class SelectedViews:
    """Tables of the chosen views: (place, grp, levels …, cnt) and (place, grp, levels …, term, freq), levels that aren't in
    the grouping being null; and what is chosen."""

    counts: DataFrame
    words: DataFrame
    chosen: dict[str, Chosen] = field(default_factory=dict)
    countries: DataFrame | None = None

    @staticmethod
    def build(objects: DataFrame, places: GridPlaces | NodePlaces, counts: Iterable[tuple[int, str]], words: Iterable[tuple[int, str]] = ()) -> SelectedViews:
        """The views of (place, grouping). Each object is read once and goes to those views only that its places have."""
        spark = objects.sparkSession
        tables = []
        for kind, pairs in (("cnt", counts), ("freq", words)):
            rows = [(p, aggregate.id_of(g)) for p, g in pairs]
            placed = places.placed(objects, spark.createDataFrame(rows, "place bigint, grp int"))
            levels = [F.when(F.col("grp").bitwiseAND(F.lit(1 << (6 - i))) == 0, F.col(x)).alias(x) for i, x in enumerate(DIMENSIONS)]
            term = [F.explode("tags").alias("term")] if kind == "freq" else []
            tables.append(placed.select("place", "grp", *levels, *term).groupBy("place", "grp", *DIMENSIONS, *(["term"] if term else [])).agg(F.count("*").alias(kind)))
        return SelectedViews(*tables, countries=aggregate.countries_of(objects))

    def save(self, path: str) -> None:
        """Both tables, sorted by place so that a range reads few row groups, and the cities' countries."""
        for name, df in (("counts", self.counts), ("words", self.words)):
            df.repartitionByRange("place").sortWithinPartitions("place", "grp").write.mode("overwrite").parquet(f"{path}/{name}")
        self.countries.write.mode("overwrite").parquet(f"{path}/countries")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SelectedViews:
        """Stored views, with the sizes that they turned out to have."""
        counts, words, countries = (spark.read.parquet(f"{path}/{x}") for x in ("counts", "words", "countries"))
        chosen: dict[str, Chosen] = {}
        for measure, df in (("count", counts), ("topk", words)):
            have: Chosen = defaultdict(dict)
            for r in df.groupBy("place", "grp").count().toLocalIterator():
                have[r.place][_BY_ID[r.grp]] = r["count"]
            chosen[measure] = dict(have)
        return cls(counts, words, chosen, countries)


class SelectedExecutor:
    """Answers from stored views where the query's range has them, and from the objects elsewhere."""

    def __init__(self, objects: DataFrame, views: SelectedViews, places: GridPlaces | NodePlaces):
        self.objects, self.views, self.places = objects, views, places

    def plan(self, q: WarehouseQuery) -> dict[int, str]:
        """The view that each place of the range is answered from: that of the query's grouping, else the smallest it
        follows from. Places without one are not in it."""
        if not q.spatial_only:
            return {}
        serves = lambda g: g == q.group or (is_ancestor(g, q.group) and ("country" not in q.levels or "country" in levels_of(g) or self.views.countries is not None))
        best = {}
        for p, views in self.views.chosen.get("topk" if q.measure == "topk" else "count", {}).items():
            usable = [g for g in views if serves(g)]
            if usable:
                best[p] = min(usable, key=lambda g: (g != q.group, views[g], g))
        return {p: best[p] for p in self.places.usable(q, best)}

    def execute(self, q: WarehouseQuery) -> DataFrame:
        """As the naive executor answers."""
        plan = self.plan(q)
        if not plan:
            return executor.execute(self.objects, q)
        value, extra, table = ("freq", ("term",), self.views.words) if q.measure == "topk" else ("cnt", (), self.views.counts)
        keys = (*extra, *q.levels)
        used = self.objects.sparkSession.createDataFrame([(p, aggregate.id_of(g)) for p, g in plan.items()], "place bigint, grp int")
        found = table.where(F.col("place").between(min(plan), max(plan))).join(F.broadcast(used), ["place", "grp"])
        parts = []
        for g in sorted(set(plan.values())):
            own = found.where(F.col("grp") == aggregate.id_of(g)).select(*extra, *levels_of(g), value)
            parts.append(aggregate.roll_up(own, g, q.group, self.views.countries, value, extra).select(*keys, value))
        lat, lon = F.col("lat"), F.col("lon")
        rest = self.objects.where(q.range.contains(lat, lon, q.closed)) if q.range else self.objects
        rest = self.places.without(rest, list(plan))
        parts.append((aggregate.word_counts(rest, q.group) if extra else aggregate.count(rest, q.group)).select(*keys, value))
        both = aggregate.merged_counts(reduce(DataFrame.unionByName, parts), keys, value)
        if extra:
            return aggregate.ranked(both, q.levels, q.k).select(*q.levels, "term", "freq", "rnk")
        return executor.ordered(both if q.levels else both.select(F.lit(NONE).alias("grouping"), "cnt"), q)
