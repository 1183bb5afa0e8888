import random

import numpy as np
import pytest

from geostrata.functions.spatial import Grid, Rect, node_id
from geostrata.operators import aggregate, matching, partition, stats
from geostrata.plans import advisor, cubes, selected
from geostrata.plans.cubes import GridExecutor, QuadTreeExecutor, Views
from geostrata.plans.executor import NaiveExecutor
from geostrata.plans.query import WarehouseQuery
from geostrata.schema import GROUPS, NONE, ROOT, levels_of
from geostrata.sources.warehouse import objects
from geostrata.sources.workload import rectangles
from tests.compare import SMALL, rows


@pytest.fixture(scope="module")
def held(spark):
    return objects(spark, SMALL).cache()


@pytest.fixture(scope="module")
def views(held):
    grid = GridExecutor.build(held, Grid(12, 24), (ROOT, "city day"), (ROOT,))
    tree = QuadTreeExecutor.build(held, 4, (ROOT, "city day"), (ROOT,))
    for v in (grid, tree):
        v.counts = {g: d.cache() for g, d in v.counts.items()}
        v.words = {g: d.cache() for g, d in v.words.items()}
        v.countries = v.countries.cache()
    return grid, tree


@pytest.mark.parametrize("seed", range(8))
def test_all_executors_agree(held, views, seed):
    rng = random.Random(seed)
    lat, lon = sorted(rng.uniform(-92, 92) for _ in range(2)), sorted(rng.uniform(-182, 182) for _ in range(2))
    if seed % 3 == 0:  # on borders of cells
        lat, lon = [15 * round(x / 15) for x in lat], [15 * round(x / 15) for x in lon]
    q = WarehouseQuery(group=GROUPS[(seed * 7) % 30], range=Rect(lat[0], lon[0], lat[1], lon[1]), closed=seed % 2 == 1, measure="topk" if seed > 5 else "count", k=3)
    want = rows(NaiveExecutor(held).execute(q))
    grid, tree = views
    assert rows(GridExecutor(held, grid, Grid(12, 24)).execute(q)) == want
    assert rows(QuadTreeExecutor(held, tree, 4).execute(q)) == want


def test_views_are_saved_updated_and_chosen(spark, held, views, tmp_path):
    grid = views[0]
    assert grid.choose(WarehouseQuery(group="city day")) == "city day" and grid.choose(WarehouseQuery(group="week")) == "city day" and grid.choose(WarehouseQuery(group="topic")) == ROOT
    assert Views().choose(WarehouseQuery()) is None
    grid.save(str(tmp_path / "v"))
    again = Views.load(spark, str(tmp_path / "v"))
    assert again.sizes["city day"] == grid.counts["city day"].count() and again.choose(WarehouseQuery(group="country week")) == "city day"
    q = WarehouseQuery(group="country week", range=Rect(-40, -100, 50, 100))
    assert rows(GridExecutor(held, again, Grid(12, 24)).execute(q)) == rows(NaiveExecutor(held).execute(q))
    half = held.where("id < 500"), held.where("id >= 500")
    parts = [GridExecutor.build(h, Grid(12, 24), ("city",)).counts["city"] for h in half]
    assert rows(cubes.updated(*parts)) == rows(GridExecutor.build(held, Grid(12, 24), ("city",)).counts["city"])


def test_roll_up_needs_an_ancestor(held):
    with pytest.raises(ValueError):
        aggregate.roll_up(aggregate.count(held, "week"), "week", "month")
    with pytest.raises(ValueError):
        aggregate.roll_up(aggregate.count(held, "city"), "city", "country")


def test_empty_objects(held):
    none = held.where("false")
    assert aggregate.count(none, NONE).count() == 0 and aggregate.count(none, "city").count() == 0 and aggregate.topk(none, NONE, 3).count() == 0
    assert GridExecutor(none, GridExecutor.build(none, Grid(4, 4), (ROOT,)), Grid(4, 4)).execute(WarehouseQuery()).count() == 0


def test_partial_lattice(held):
    part = aggregate.lattice(held, (), ("country day", "topic"))
    assert {r.grp for r in part.collect()} == {aggregate.id_of("country day"), aggregate.id_of("topic")}


@pytest.mark.parametrize("name", sorted(partition.PARTITIONERS))
def test_partitioners(spark, held, tmp_path, name):
    g, n = Grid(32, 32), 4
    loads = partition.load_array(stats.objects_by_cell(held, g), g)
    leaves = partition.PARTITIONERS[name](loads, n)
    seen = np.zeros((32, 32), int)
    for x in leaves:
        seen[x.r0 : x.r1, x.c0 : x.c1] += 1
        assert x.load == loads[x.r0 : x.r1, x.c0 : x.c1].sum()
    assert (seen == 1).all()
    share = partition.partition_loads(leaves, n)
    assert sum(share) == loads.sum() and max(share) < 1.6 * min(share)
    got = {r.partition: r.objects for r in partition.partition_info(held, leaves, g).collect()}
    assert [got.get(p, 0) for p in range(n)] == share
    partition.save(spark, leaves, g, str(tmp_path / name))
    again, grid = partition.load(spark, str(tmp_path / name))
    assert sorted(again, key=str) == sorted(leaves, key=str) and grid == g
    assert partition.laid_out(held, leaves, g, n).rdd.getNumPartitions() == n
    assert partition.tree_text(leaves).count("\n") == len({x.partition for x in leaves}) - 1


def test_partitioners_without_load():
    for make in partition.PARTITIONERS.values():
        leaves = make(np.zeros((8, 8)), 4)
        assert sum((x.r1 - x.r0) * (x.c1 - x.c0) for x in leaves) == 64


def test_advisor(spark, held):
    stats_ = advisor.collected(advisor.candidates(held, rectangles(held, 0.4), Grid(4, 8)), "cell")
    free = advisor.select_views(stats_, 10**9)
    assert free and all(s.worth_it for s in stats_ if (s.place, s.group) in free)
    size = {(s.place, s.group): s.cardinality for s in stats_}
    budget = sum(size[x] for x in free) // 3
    tight = advisor.select_views(stats_, budget)
    assert 0 < sum(size[x] for x in tight) <= budget
    costs = [advisor.query_cost(stats_, set(x)) for x in ([], tight, free)]
    assert costs[0] > costs[1] >= costs[2]
    assert advisor.region_load([s for s in stats_ if s.place == stats_[0].place]) > 0


def test_greedy_choice_against_the_slow_way():
    rng = random.Random(5)
    groups = ("city day", "country day", "city", "country", "day")
    made = [advisor.Stat(p, g, n, max(1, rng.randint(1, n) // (1 + 3 * i)), rng.randint(0, 9)) for p in range(6) for n in [rng.randint(20, 90)] for i, g in enumerate(groups)]
    budget = 40
    by = {(s.place, s.group): s for s in made}
    pool = [s for s in made if s.worth_it and not any(o.worth_it and advisor.is_ancestor(o.group, s.group) and s.through(o) <= s.with_view for o in made if o.place == s.place)]
    if sum(s.cardinality for s in pool) <= budget:
        pytest.skip("everything fits")
    chosen, used, left = [], 0, list(pool)
    while left:
        before = advisor.query_cost(made, set(chosen))
        gain = {(s.place, s.group): (before - advisor.query_cost(made, {*chosen, (s.place, s.group)}) - s.objects) / s.cardinality for s in left}
        best = max(left, key=lambda s: (gain[s.place, s.group], -s.place, s.group))
        if gain[best.place, best.group] <= 0:
            break
        left.remove(best)
        if used + best.cardinality <= budget:
            chosen.append((best.place, best.group))
            used += best.cardinality
    got = advisor.select_views(made, budget)
    assert advisor.query_cost(made, set(got)) == advisor.query_cost(made, set(chosen)) and sum(by[x].cardinality for x in got) <= budget


def test_node_candidates(spark, held):
    got = advisor.node_candidates(held, rectangles(held, 0.4), 2)
    assert {r.node for r in got.where("grouping = 'none'").collect()} == {r.node for r in stats.objects_by_node(held, 2).collect()}
    assert got.where("queries > 0").count() > 0


def test_workload_is_in_the_domain_and_repeatable(held):
    a, b = rectangles(held, 0.1), rectangles(held.repartition(7), 0.1)
    assert rows(a) == rows(b)
    assert a.where("lat_from < -90 or lon_from < -180 or lat_to >= 90 or lon_to >= 180 or lat_from > lat_to or lon_from > lon_to").count() == 0
    inside = a.join(held.select("id", "lat", "lon"), a.query_id == held.id).where("lat between lat_from and lat_to and lon between lon_from and lon_to")
    assert inside.count() == held.count()


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("name", sorted(matching.STRATEGIES))
def test_matching_strategies(spark, held, name, few, monkeypatch):
    monkeypatch.setattr(matching, "BROADCAST_QUERIES", 100 if few else 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10_000_000 if few else -1)
    queries = [
        WarehouseQuery(query_id=2, range=Rect(-50, -50, 50, 50), topic="view"),
        WarehouseQuery(query_id=3, keywords=("k3", "view"), closed=True),
        WarehouseQuery(query_id=4, range=Rect(10, 10, 60, 90), closed=True, group="city"),
        WarehouseQuery(query_id=5, range=Rect(-50, -50, 50, 50), keywords=("Click",), group="city"),
        WarehouseQuery(query_id=6, topic="view", group="country day"),
        WarehouseQuery(query_id=7, measure="topk", k=2, range=Rect(-95, -200, 95, 200), group="topic"),
        WarehouseQuery(query_id=8),
    ]
    found = matching.STRATEGIES[name](held, matching.query_table(spark, queries))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and (few or "SortMergeJoin" in plan or "ShuffledHashJoin" in plan)
    counts = {(r.query_id, r.key): r.cnt for r in matching.counts(found).collect()}
    words = {(r.query_id, r.key, r.rnk): (r.term, r.freq) for r in matching.best_words(matching.words(found)).collect()}
    want, best = {}, {}
    for q in queries:
        for r in NaiveExecutor(held).execute(q).collect():
            key = "\x01".join(r[x] for x in levels_of(q.group)) or NONE
            if q.measure == "count":
                want[q.query_id, key] = r.cnt
            else:
                best[q.query_id, key, r.rnk] = (r.term, r.freq)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counts == want and words == best
    nothing = matching.STRATEGIES[name](held, matching.query_table(spark, []))
    assert nothing.count() == 0 and matching.counts(nothing).count() == 0


@pytest.mark.parametrize("kind", ["grid", "quadtree"])
def test_selected_views(spark, held, kind, tmp_path):
    """Views of some places only, chosen at random; ranges at random; every answer is that of the naive executor."""
    rng = random.Random(4)
    places = selected.GridPlaces(Grid(6, 8)) if kind == "grid" else selected.NodePlaces(3)
    every = [(r << 16) + c for r in range(6) for c in range(8)] if kind == "grid" else [node_id(lv, r, c) for lv in range(4) for r in range(1 << lv) for c in range(1 << lv)]
    pick = lambda groups: [(p, g) for p in every for g in groups if rng.random() < 0.4]
    views = selected.SelectedViews.build(held, places, pick(["city hour topic", "city day", "country", "topic"]), pick(["city", "country"]))
    views.save(str(tmp_path / "v"))
    views = selected.SelectedViews.load(spark, str(tmp_path / "v"))
    ex = selected.SelectedExecutor(held, views, places)
    served = 0
    for k in range(8):
        a, b = sorted(rng.uniform(-90, 90) for _ in "ab"), sorted(rng.uniform(-180, 180) for _ in "ab")
        r = None if k == 0 else Rect(-90, -180, 90, 180) if k == 1 else Rect(a[0], b[0], a[1], b[1])
        for q in (WarehouseQuery(group=rng.choice(["country week", "topic", "city day", "none"]), range=r, order="desc"), WarehouseQuery(measure="topk", k=3, group=rng.choice(["country", "none", "city"]), range=r)):
            served += len(ex.plan(q))
            assert rows(ex.execute(q)) == rows(NaiveExecutor(held).execute(q))
    assert served > 20
    assert ex.plan(WarehouseQuery(group="topic", topic="view")) == {} == ex.plan(WarehouseQuery(group="hour", measure="topk"))
