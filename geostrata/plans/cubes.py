"""Aggregates by grid cell or quadtree node that answer range queries: what lies inside of a range comes from a view,
the objects along its border are counted themselves. The two branches never share a cell, so nothing counts twice."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import spatial
from geostrata.functions.spatial import Grid, Rect
from geostrata.operators import aggregate
from geostrata.plans import executor
from geostrata.plans.query import WarehouseQuery
from geostrata.schema import GROUPS, NONE, is_ancestor, level, levels_of

#: Nodes that are listed in a filter, which Parquet statistics can use; more are joined.
LISTED_NODES = 200


@dataclass
class Views:
    """Materialized aggregates by grouping: of counts (place …, levels …, cnt) and of words (…, term, freq).

    `sizes` holds their numbers of rows as far as they are known; without them, coarser groupings count as smaller.
    """

    counts: dict[str, DataFrame] = field(default_factory=dict)
    words: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    countries: DataFrame | None = None

    def of(self, measure: str) -> dict[str, DataFrame]:
        return self.words if measure == "topk" else self.counts

    def choose(self, q: WarehouseQuery) -> str | None:
        """The view of the query's grouping, else the smallest that it follows from."""
        have = self.of(q.measure)
        if q.group in have:
            return q.group
        usable = [g for g in have if is_ancestor(g, q.group) and ("country" not in q.levels or "country" in levels_of(g) or self.countries is not None)]
        return min(usable, key=lambda g: (self.sizes.get(g, float("inf")), -level(g), g), default=None)

    def save(self, path: str) -> None:
        """Each view as a Parquet table, clustered by place, so a range reads few row groups."""
        for kind, views in (("counts", self.counts), ("words", self.words)):
            for g, df in views.items():
                df.sortWithinPartitions(df.columns[0], *df.columns[1:2]).write.mode("overwrite").parquet(f"{path}/{kind}/{GROUPS.index(g)}")
        rows = [(kind, g, GROUPS.index(g)) for kind, v in (("counts", self.counts), ("words", self.words)) for g in v]
        spark = next(iter([*self.counts.values(), *self.words.values()])).sparkSession
        spark.createDataFrame(rows, "kind string, grouping string, number int").coalesce(1).write.mode("overwrite").parquet(f"{path}/views")
        if self.countries is not None:
            self.countries.write.mode("overwrite").parquet(f"{path}/countries")

    @classmethod
    def load(cls, spark: SparkSession, path: str, with_countries: bool = True) -> Views:
        out = cls()
        for r in spark.read.parquet(f"{path}/views").collect():
            df = spark.read.parquet(f"{path}/{r['kind']}/{r['number']}")
            (out.words if r["kind"] == "words" else out.counts)[r["grouping"]] = df
            if r["kind"] == "counts":
                out.sizes[r["grouping"]] = df.count()
        if with_countries:
            out.countries = spark.read.parquet(f"{path}/countries")
        return out


class _CubeExecutor:
    """What the grid and the quadtree executor have in common."""

    places: tuple[str, ...]

    def __init__(self, objects: DataFrame, views: Views, grid: Grid):
        self.objects, self.views, self.grid = objects, views, grid

    def _inside(self, view: DataFrame, r: Rect) -> DataFrame:
        raise NotImplementedError

    def execute(self, q: WarehouseQuery) -> DataFrame:
        """As the naive executor answers, which takes over where no view can serve: for predicates other than the
        range, and where no view of a finer grouping is there."""
        group = self.views.choose(q)
        if group is None or not q.spatial_only:
            return executor.execute(self.objects, q)
        value, extra = ("freq", ("term",)) if q.measure == "topk" else ("cnt", ())
        r = q.range or spatial.WORLD
        lat, lon = F.col("lat"), F.col("lon")
        within = self.grid.in_box(lat, lon, self.grid.inside(r)) & spatial.in_domain(lat, lon)
        rest = self.objects.where((q.range.contains(lat, lon, q.closed) if q.range else F.lit(True)) & ~within)
        keys = (*extra, *q.levels)
        inner = self._inside(self.views.of(q.measure)[group], r)
        inner = aggregate.roll_up(inner, group, q.group, self.views.countries, value, extra).select(*keys, value)
        outer = (aggregate.word_counts(rest, q.group) if extra else aggregate.count(rest, q.group)).select(*keys, value)
        both = aggregate.merged_counts(inner.unionByName(outer), keys, value)
        if extra:
            return aggregate.ranked(both, q.levels, q.k).select(*q.levels, "term", "freq", "rnk")
        out = both if q.levels else both.select(F.lit(NONE).alias("grouping"), "cnt")
        return executor.ordered(out, q)


class GridExecutor(_CubeExecutor):
    """Views by grid cell: (grid_row, grid_col, levels …, value)."""

    def _inside(self, view: DataFrame, r: Rect) -> DataFrame:
        r0, c0, r1, c1 = self.grid.inside(r)
        return view.where(F.col("grid_row").between(r0, r1 - 1) & F.col("grid_col").between(c0, c1 - 1))

    @staticmethod
    def build(objects: DataFrame, grid: Grid, groups: tuple[str, ...], words: tuple[str, ...] = ()) -> Views:
        """Views of the given groupings; those of counts all come from one aggregate by cell and the finest of them."""
        placed = objects.where(spatial.in_domain(F.col("lat"), F.col("lon"))).withColumns({"grid_row": grid.row(F.col("lat")), "grid_col": grid.col(F.col("lon"))})
        return _views(objects, placed, ("grid_row", "grid_col"), groups, words)


class QuadTreeExecutor(_CubeExecutor):
    """Views by node on all levels down to one: (node, levels …, value). A range takes the fewest nodes that tile it."""

    def __init__(self, objects: DataFrame, views: Views, depth: int):
        super().__init__(objects, views, Grid(1 << depth, 1 << depth))
        self.depth = depth

    def _inside(self, view: DataFrame, r: Rect) -> DataFrame:
        nodes, _ = spatial.cover(r, self.depth)
        if len(nodes) <= LISTED_NODES:
            return view.where(F.col("node").isin(nodes))
        listed = view.sparkSession.createDataFrame([(n,) for n in nodes], "node bigint")
        return view.join(F.broadcast(listed), "node", "left_semi")  # at most some 4 * 2**depth rows

    @staticmethod
    def build(objects: DataFrame, depth: int, groups: tuple[str, ...], words: tuple[str, ...] = ()) -> Views:
        placed = objects.where(spatial.in_domain(F.col("lat"), F.col("lon"))).withColumn("node", spatial.quadtree_node(F.col("lat"), F.col("lon"), depth))
        leaves = _views(objects, placed, ("node",), groups, words)
        up = lambda df, value, *extra: aggregate.raised(df, depth, value, *extra)
        return replace(leaves, counts={g: up(v, "cnt", *levels_of(g)) for g, v in leaves.counts.items()}, words={g: up(v, "freq", *levels_of(g), "term") for g, v in leaves.words.items()})


def _views(objects: DataFrame, placed: DataFrame, place: tuple[str, ...], groups: tuple[str, ...], words: tuple[str, ...]) -> Views:
    counts = {g: placed.groupBy(*place, *levels_of(g)).agg(F.count("*").alias("cnt")) for g in groups}
    exploded = placed.withColumn("term", F.explode("tags"))
    freqs = {g: exploded.groupBy(*place, *levels_of(g), "term").agg(F.count("*").alias("freq")) for g in words}
    return Views(counts, freqs, countries=aggregate.countries_of(objects))


def updated(view: DataFrame, batch_view: DataFrame, value: str = "cnt") -> DataFrame:
    """A view with the aggregate of further objects added to it; only aggregates are read."""
    keys = tuple(c for c in view.columns if c != value)
    return aggregate.merged_counts(view.unionByName(batch_view), keys, value)
