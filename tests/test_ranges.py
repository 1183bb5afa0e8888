"""Queries that are counted together, against those that meet the objects one by one."""

import random
import shutil

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geostrata import registry
from geostrata.functions import spatial
from geostrata.functions.spatial import Rect
from geostrata.operators import aggregate, matching, ranges
from geostrata.plans import advisor
from geostrata.plans.query import WarehouseQuery
from geostrata.sources.warehouse import objects
from tests.compare import SMALL, oracle, rows

NAMES = ("match_by_keyword", "match_by_scan", "match_by_topic", "match_topk", "match_by_cell")


@pytest.mark.parametrize("n", [0, 1, ranges.FEW_POINTS, ranges.FEW_POINTS + 1, 64, 300])
def test_count_against_brute_force(n):
    """Points on corners of rectangles and on each other, NaN, rectangles that are closed, empty or the wrong way round."""
    rng = np.random.default_rng(n)
    some = np.array([*range(-5, 6), np.nan, 0.5, -0.0, np.inf, -np.inf])
    lat, lon = rng.choice(some, n), rng.choice(some, n)
    a, b, c, d = (rng.choice(some, 400) for _ in range(4))
    closed = rng.random(400) < 0.5
    r = ranges.Rects(np.arange(400), a, b, c, d, closed, np.zeros(400, bool), np.zeros(400, np.int32))
    key = lambda x: (1, 0.0) if x != x else (0, x)
    inside = lambda x, low, top, shut: key(x) >= key(low) and (key(x) < key(top) or shut and key(x) == key(top))
    want = [sum(inside(x, a[i], c[i], closed[i]) and inside(y, b[i], d[i], closed[i]) for x, y in zip(lat, lon)) for i in range(400)]
    assert ranges.count(lat, lon, r).tolist() == want


def made(rng: random.Random, n: int = 120) -> list[WarehouseQuery]:
    corner = lambda top: sorted(rng.choice([rng.uniform(-top, top), 15.0 * rng.randint(-6, 6)]) for _ in "ab")
    out = []
    for i in range(n):
        lat, lon = corner(90), corner(180)
        r = rng.choice([None, *[Rect(lat[0], lon[0], lat[1], lon[1])] * 5, Rect(lat[1], lon[0], lat[0], lon[1])])
        out.append(WarehouseQuery(query_id=i, measure=rng.choice(["count", "topk"]), k=rng.randint(0, 4), group=rng.choice(["city day", "none", "topic"]), range=r, topic=rng.choice([None, "click"]), keywords=rng.choice([(), ("K3",)]), closed=rng.random() < 0.5))
    return out


@pytest.fixture(scope="module")
def held(spark):
    """Some objects have no latitude, and some are NaN."""
    lat = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.round(F.col("lat") / 15) * 15)
    return objects(spark, SMALL).withColumn("lat", lat.cast("double")).cache()


@pytest.mark.parametrize("name, how", [("scan", "all"), ("topic", "some"), ("keyword", "some"), ("cell", "some"), ("cell", "pieces"), ("cell", "repeated")])
def test_together_as_one_by_one(spark, held, name, how, monkeypatch):
    monkeypatch.setattr(matching, "TOGETHER", 4 if how == "some" else 1)
    monkeypatch.setattr(matching, "PIECE", 60 if how in ("pieces", "some") else matching.PIECE)
    match, queries = matching.STRATEGIES[name], matching.query_table(spark, made(random.Random(name + how)))
    if how == "repeated":
        queries = queries.withColumn("query_id", (F.col("query_id") / 2).cast("bigint"))
    got = rows(matching.counted(held, queries, match))
    assert got == rows(matching.counts(match(held, queries))) and len(got[1]) > 50
    got = rows(matching.best_counted(held, queries, match))
    assert got == rows(matching.best_words(matching.words(match(held, queries)))) and len(got[1]) > 50


def test_no_queries_and_nothing_met(spark, held, monkeypatch):
    monkeypatch.setattr(matching, "TOGETHER", 1)
    assert matching.counted(held, matching.query_table(spark, [])).count() == 0
    assert matching.counted(held, matching.query_table(spark, [WarehouseQuery(topic="no such")])).count() == 0
    assert matching.best_counted(held, matching.query_table(spark, [])).count() == 0


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """The small tables with 6000 suppliers, which make as many queries."""
    folder = tmp_path_factory.mktemp("many")
    for t in ("events", "customer", "nation", "region"):
        shutil.copy(f"{SMALL}/{t}.parquet", folder)
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (i AS s_suppkey) FROM (FROM '{SMALL}/supplier.parquet' LIMIT 1), range(1, 6001) AS r(i)) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_objects_meet_classes(spark, many, name, monkeypatch):
    """What objects meet doesn't grow with the queries: there are 16 classes of them."""
    seen, init = [], matching._Meeting.__init__

    def counting(self, *args):
        init(self, *args)
        seen.append(sum(self.number.values()))

    monkeypatch.setattr(matching._Meeting, "__init__", counting)
    assert rows(registry.queries()[name](spark, many)) == oracle(registry.oracle_sql()[name], many)
    assert seen and max(seen) <= 16


def test_statistics_of_nodes(spark):
    """All groupings of all nodes as the lattice has them; what has the hour is not multiplied by the groupings."""
    held = objects(spark, SMALL).withColumn("city", F.when(F.col("id") % 7 > 0, F.col("city")))
    placed = held.withColumn("node", F.explode(F.array(*(spatial.quadtree_node(F.col("lat"), F.col("lon"), lv) for lv in range(3)))))
    want = aggregate.lattice(placed, ("node",)).groupBy("node", "grp").agg(F.sum("cnt").alias("objects"), F.count("*").alias("cardinality"))
    got = advisor.node_candidates(held, registry.workload(spark, SMALL), 2)
    assert rows(got.select("node", "grouping", "objects", "cardinality")) == rows(want.select("node", advisor.group_names()[F.col("grp")].alias("grouping"), "objects", "cardinality"))
    expanded = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Expand" in x]
    assert expanded and not any("hour#" in x for x in expanded)
