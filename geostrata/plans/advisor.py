"""Which views to materialize: statistics by place and grouping, costs, and a greedy choice under a budget."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions import spatial, times
from geostrata.functions.spatial import Grid
from geostrata.operators import aggregate
from geostrata.schema import GROUPS, is_ancestor, levels_of

#: Rows of all views together.
BUDGET = 120_000
#: Rows of one key in a view of words: so many counters, each with a count besides its name.
WORD_ROWS = 10 * (3 + 1)


@dataclass(frozen=True)
class Stat:
    """A place (cell or node) and grouping: its objects, distinct keys, and the queries of the workload there."""

    place: int
    group: str
    objects: int
    cardinality: int
    queries: int

    @property
    def without_view(self) -> int:
        return self.queries * self.objects

    @property
    def with_view(self) -> int:
        return self.objects + self.cardinality * self.queries

    def through(self, ancestor: Stat) -> int:
        return ancestor.cardinality * self.queries

    @property
    def worth_it(self) -> bool:
        return self.queries > 0 and self.with_view < self.without_view


def group_names() -> F.Column:
    pairs = [x for g in GROUPS for x in (F.lit(aggregate.id_of(g)), F.lit(g))]
    return F.create_map(*pairs)


_FINEST = ("country", "city", "hour", "topic")


def finest(objects: DataFrame, place: str) -> DataFrame:
    """(place, country, city, hour, topic, n): what all statistics follow from."""
    return objects.groupBy(place, *_FINEST).agg(F.count("*").alias("n"))


def key_statistics(fine: DataFrame, place: str) -> DataFrame:
    """(place, grouping, objects, cardinality) of all groupings, from counts `n` by place, country, city, hour and topic.

    Keys that have the hour are told apart within a place and hour, so one shuffle serves them all: only the counts of
    days, which are few, are multiplied by the groupings.
    """
    keys, n = (place, "hour"), F.sum("n").alias("n")
    fine = fine.repartition(*keys).groupBy(*keys, "country", "city", "topic").agg(n)

    def named(rows: DataFrame, **cardinalities: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(g.replace("_", " ")).alias("grouping"), F.col(c).alias("cardinality")) for g, c in cardinalities.items()))
        return rows.select(place, "n", F.explode(each).alias("x")).select(place, "x.grouping", F.col("n").alias("objects"), "x.cardinality")

    def of_space(x: str) -> DataFrame:
        rows = fine.groupBy(*keys, x, "topic").agg(n).groupBy(*keys, x).agg(F.count("*").alias("topics"), n)
        return rows.groupBy(*keys).agg(F.sum("topics").alias("topics"), F.count("*").alias("spaces"), n).groupBy(place).agg(F.sum("topics").alias("topics"), F.sum("spaces").alias("spaces"), F.count("*").alias("hours"), n)

    topics = fine.groupBy(*keys, "topic").agg(n).groupBy(place).agg(F.count("*").alias("topics"), n)
    parts = [named(of_space("city"), city_hour_topic="topics", city_hour="spaces", hour="hours"), named(of_space("country"), country_hour_topic="topics", country_hour="spaces"), named(topics, hour_topic="topics")]
    day = fine.groupBy(place, "country", "city", times.rolled_up(F.col("hour"), "hour", "day").alias("day"), "topic").agg(n)
    days = day.withColumns({x: times.rolled_up(F.col("day"), "day", x) for x in ("week", "month")})
    counts = aggregate.grouped(days, (place,), tuple(g for g in GROUPS if "hour" not in levels_of(g)))
    by_id = counts.groupBy(place, "grp").agg(F.sum("cnt").alias("objects"), F.count("*").alias("cardinality"))
    return reduce(DataFrame.unionByName, [*parts, by_id.select(place, group_names()[F.col("grp")].alias("grouping"), "objects", "cardinality")])


def queries_by_cell(queries: DataFrame, grid: Grid) -> DataFrame:
    """(cell, grouping, queries): the queries whose rectangle touches a cell."""
    return grid.cells(queries).groupBy("cell", "grouping").agg(F.count("*").alias("queries"))


def queries_by_node(queries: DataFrame, depth: int) -> DataFrame:
    """(node, grouping, queries): the queries whose rectangle encloses a node of a level up to `depth`."""
    out = None
    for lv in range(depth + 1):
        g = Grid(1 << lv, 1 << lv)
        inside = g.cells(queries, "inside").select(spatial.node_id(lv, F.col("grid_row"), F.col("grid_col")).alias("node"), "grouping")
        out = inside if out is None else out.unionByName(inside)
    return out.groupBy("node", "grouping").agg(F.count("*").alias("queries"))


def candidates(objects: DataFrame, queries: DataFrame, grid: Grid) -> DataFrame:
    """(cell, grouping, objects, cardinality, queries, with_view, without_view, worth_it) of the cells with objects."""
    placed = objects.where(spatial.in_domain(F.col("lat"), F.col("lon"))).withColumn("cell", grid.cell(F.col("lat"), F.col("lon")))
    return costed(key_statistics(finest(placed, "cell"), "cell").join(queries_by_cell(queries, grid), ["cell", "grouping"], "left"))


def node_candidates(objects: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """The same by quadtree node, on all levels."""
    placed = objects.where(spatial.in_domain(F.col("lat"), F.col("lon"))).withColumn("node", spatial.quadtree_node(F.col("lat"), F.col("lon"), depth))
    fine = finest(placed, "node").withColumn("node", F.explode(spatial.nodes_above(F.col("node"), depth)))
    return costed(key_statistics(fine, "node").join(queries_by_node(queries, depth), ["node", "grouping"], "left"))


def costed(stats: DataFrame) -> DataFrame:
    stats = stats.withColumn("queries", F.coalesce("queries", F.lit(0).cast("bigint")))
    with_view, without = F.col("objects") + F.col("cardinality") * F.col("queries"), F.col("queries") * F.col("objects")
    return stats.withColumns({"with_view": with_view, "without_view": without, "worth_it": (F.col("queries") > 0) & (with_view < without)})


def collected(stats: DataFrame, place: str) -> list[Stat]:
    """Statistics on the driver. There are at most as many as places times groupings, whatever the number of objects."""
    return [Stat(r[place], r["grouping"], r["objects"], r["cardinality"], r["queries"]) for r in stats.toLocalIterator()]


def query_cost(stats: Iterable[Stat], chosen: set[tuple[int, str]]) -> int:
    """What the workload costs: each grouping of a place is answered by its view, the best view it follows from, or the
    objects."""
    by = {(s.place, s.group): s for s in stats}
    views = defaultdict(list)
    for place, group in chosen:
        views[place].append(by[place, group])
    return sum(min([s.without_view, *(s.through(v) for v in views[s.place] if v.group == s.group or is_ancestor(v.group, s.group))]) for s in by.values())


def select_views(stats: list[Stat], budget: int = BUDGET, rows_per_key: int = 1) -> list[tuple[int, str]]:
    """(place, grouping) of the views to materialize.

    Views pay where they save more than their upkeep, which is one update an object. Of those, groupings that already
    follow from a view that is no dearer are left out. If the rest exceeds the budget, views are taken by what they save
    for a row of their size until it is used up; gains of the others shrink as views are taken, so each gain is computed
    anew when its turn comes.
    """
    by_place: dict[int, dict[str, Stat]] = defaultdict(dict)
    for s in stats:
        by_place[s.place][s.group] = s
    pool = [s for s in stats if s.worth_it]
    pool = [s for s in pool if not any(o.worth_it and is_ancestor(o.group, s.group) and s.through(o) <= s.with_view for o in by_place[s.place].values())]
    size = lambda s: s.cardinality * rows_per_key
    if sum(map(size, pool)) <= budget:
        return sorted((s.place, s.group) for s in pool)
    cost = {(s.place, s.group): s.without_view for s in stats}

    def gain(v: Stat) -> float:
        saved = sum(max(0, cost[s.place, s.group] - s.through(v)) for s in by_place[v.place].values() if s.group == v.group or is_ancestor(v.group, s.group))
        return (saved - v.objects) / size(v)

    heap = [(-gain(s), s.place, s.group) for s in pool]
    heapq.heapify(heap)
    chosen, used = [], 0
    while heap:
        _, place, group = heapq.heappop(heap)
        v = by_place[place][group]
        now = gain(v)
        if now <= 0 or used + size(v) > budget:
            continue
        if heap and -heap[0][0] > now:
            heapq.heappush(heap, (-now, place, group))
            continue
        chosen.append((place, group))
        used += size(v)
        for s in by_place[place].values():
            if s.group == group or is_ancestor(group, s.group):
                cost[place, s.group] = min(cost[place, s.group], s.through(v))
    return sorted(chosen)


def region_load(stats: Iterable[Stat]) -> int:
    """The load of one place: its objects and, for each grouping, the cheaper of its view and the objects."""
    own = list(stats)
    return max((s.objects for s in own), default=0) + sum(min(s.without_view, s.with_view) for s in own)


def region_loads(stats: DataFrame, place: str) -> DataFrame:
    """(place, load) within a plan, from costed statistics."""
    return stats.groupBy(place).agg((F.max("objects") + F.sum(F.least("with_view", "without_view"))).alias("load"))
