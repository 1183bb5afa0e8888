"""Every registered query of the engine on whole tables; those with an oracle give its rows."""

import pytest

from geostrata import registry
from tests.compare import SMALL, oracle, rows

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert rows(registry.queries()[name](spark, SMALL)) == oracle(ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - ORACLES.keys()))
def test_without_oracle(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.01").count() > 0


def test_approximate_topk_is_exact_for_few_terms(spark):
    from geostrata.operators import aggregate
    from geostrata.sources.warehouse import objects

    o = objects(spark, SMALL)
    assert rows(aggregate.approximate_topk(o, "country", 100)) == rows(aggregate.topk(o, "country", 100))


def test_node_queries_against_brute_force(spark):
    from collections import Counter

    from geostrata.functions.spatial import Rect, node_bounds, node_id
    from geostrata.plans import advisor

    queries = registry.workload(spark, SMALL).collect()
    want = Counter()
    for q in queries:
        r = Rect(q.lat_from, q.lon_from, q.lat_to, q.lon_to)
        for lv in range(4):
            for i in range(1 << lv):
                for j in range(1 << lv):
                    b = node_bounds(node_id(lv, i, j))
                    if r.strictly_encloses(b):
                        want[node_id(lv, i, j), q.grouping] += 1
    got = advisor.queries_by_node(registry.workload(spark, SMALL), 3).collect()
    assert {(r.node, r.grouping): r.queries for r in got} == dict(want)


def test_order(spark):
    from geostrata.plans import executor
    from geostrata.plans.parser import parse
    from geostrata.sources.warehouse import objects

    o = objects(spark, SMALL)
    up = [r.cnt for r in executor.execute(o, parse("select count() from d group by city order by count() asc")).collect()]
    down = [r.cnt for r in executor.execute(o, parse("select count() from d group by city order by count()")).collect()]
    assert up == sorted(up) and down == up[::-1]


def test_predicates_reach_the_scan(spark, tmp_path):
    from datetime import date

    from geostrata.functions.spatial import Rect
    from geostrata.plans import executor
    from geostrata.plans.query import WarehouseQuery
    from geostrata.sources.objects import derived
    from geostrata.sources.warehouse import base

    base(spark, SMALL).write.parquet(str(tmp_path / "o"))
    q = WarehouseQuery(group="city day", range=Rect(0, 0, 45, 90), after=date(2024, 1, 10))
    plan = executor.execute(derived(spark.read.parquet(str(tmp_path / "o"))), q)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("GreaterThanOrEqual(lat,0.0)", "LessThan(lon,90.0)", "GreaterThanOrEqual(ts"))
    assert "text" not in plan[plan.index("ReadSchema") :] and "Python" not in plan
