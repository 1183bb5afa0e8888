import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geostrata.functions import spatial, texts, times
from geostrata.functions.spatial import Grid, Rect
from geostrata.functions.stopwords import STOPWORDS


def test_weeks(spark):
    days = [datetime.date(2013, 12, 25) + datetime.timedelta(i) for i in range(0, 1500)]

    def week(d):  # weeks begin on Sunday; the Saturday that ends a week tells its number
        saturday = d + datetime.timedelta((5 - d.weekday()) % 7)
        return -(-saturday.timetuple().tm_yday // 7)

    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", times.week_of_year(F.col("d")).alias("w"), times.week_key(F.col("d")).alias("k")).collect()
    assert all(r.w == week(r.d) and r.k == f"{r.d.year}{r.w}" for r in got)
    by = {r.d.isoformat(): r.k for r in got}
    assert (by["2014-01-01"], by["2014-12-31"]) == ("20141", "20141")


def test_time_parts(spark):
    df = spark.createDataFrame([(datetime.datetime(2014, 11, 2, 1, 11, 11),)], "ts timestamp")
    got = df.select(*(times.part(F.col("ts"), x).alias(x) for x in "year month week day hour".split())).first()
    assert tuple(got) == ("2014", "201411", "201445", "20141102", "2014110201")
    up = df.select(times.part(F.col("ts"), "hour").alias("h")).select(*(times.rolled_up(F.col("h"), "hour", x) for x in ("hour", "day", "week", "month"))).first()
    assert tuple(up) == ("2014110201", "20141102", "201445", "201411")
    assert len(df.select(times.now_text()).first()[0]) == 21


def test_splitting(spark):
    cases = {"a,,": ["a"], ",a": ["", "a"], ",": [], "": [""], "a,b,,c": ["a", "b", "", "c"], "x y": ["x y"]}
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    assert {r.t: r.p for r in df.select("t", texts.java_split(F.col("t")).alias("p")).collect()} == cases
    got = spark.createDataFrame([("B,a,b,A,the,K3",)], "t string").select(texts.folded_tags(F.col("t")), texts.without_stopwords(texts.folded_tags(F.col("t"))), texts.contains_all(F.col("t"), ("K3", "b")), texts.contains_all(F.col("t"), ("k",)))
    assert tuple(got.first()) == (["b", "a", "the", "k3"], ["k3"], True, False)
    assert len(STOPWORDS) == 523 and spark.createDataFrame([("b a b",)], "t string").select(texts.terms(F.col("t"))).first()[0] == ["b", "a"]


def test_cells_and_nodes(spark):
    points = spark.createDataFrame([(-90.0, -180.0), (0.0, 0.0), (10.0, 10.0)], "lat double, lon double")
    g = Grid()
    assert [r[0] for r in points.select(g.cell(F.col("lat"), F.col("lon"))).collect()] == [0, (500 << 16) + 500, (555 << 16) + 527]
    assert [r[0] for r in points.select(spatial.quadtree_node(F.col("lat"), F.col("lon"), 1)).collect()] == [1 << 40, (1 << 40) + (1 << 20) + 1, 1099512676353]
    assert points.select(spatial.quadtree_node(F.col("lat"), F.col("lon"), 0)).distinct().first()[0] == 0
    assert spatial.is_node_ancestor(0, spatial.node_id(3, 5, 1)) and spatial.is_node_ancestor(spatial.node_id(1, 1, 0), spatial.node_id(3, 5, 1))
    assert not spatial.is_node_ancestor(spatial.node_id(1, 0, 0), spatial.node_id(3, 5, 1)) and not spatial.is_node_ancestor(5, 5)
    assert spatial.node_bounds(spatial.node_id(1, 1, 0)) == Rect(0, -180, 90, 0)


def test_rectangles():
    a = Rect(0, 0, 10, 10)
    assert a.overlaps(Rect(9, 9, 20, 20)) and not a.overlaps(Rect(10, 0, 20, 10))
    assert a.encloses(Rect(0, 0, 10, 10)) and not a.strictly_encloses(Rect(0, 0, 5, 5)) and a.strictly_encloses(Rect(1, 1, 2, 2))
    kinds = {(-1, -1, 11, 11): "whole", (20, 20, 30, 30): "none", (-1, -1, 5, 11): "south", (5, -1, 11, 11): "north", (-1, -1, 11, 5): "west", (-1, 5, 11, 11): "east", (-1, -1, 5, 5): "south-west", (5, 5, 11, 11): "north-east", (2, 2, 3, 3): "inner"}
    assert {k: spatial.overlap_kind(Rect(*k), a) for k in kinds} == kinds


lats, lons = st.floats(-95, 95), st.floats(-185, 185)


@settings(max_examples=300, deadline=None)
@given(lats, lons, lats, lons, st.floats(-90, 89.999999), st.floats(-180, 179.999999), st.sampled_from([1, 2, 10, 64, 1000]))
def test_inside_cells_hold_inside_points_only(a, b, c, d, lat, lon, n):
    r, g = Rect(a, b, c, d), Grid(n, n)
    r0, c0, r1, c1 = g.inside(r)
    row, col = g.place(lat, lon)
    if r0 <= row < r1 and c0 <= col < c1:
        assert a <= lat < c and b <= lon < d


@settings(max_examples=100, deadline=None)
@given(lats, lons, lats, lons, st.integers(0, 5))
def test_cover_tiles_the_inside(a, b, c, d, level):
    nodes, (r0, c0, r1, c1) = spatial.cover(Rect(a, b, c, d), level)
    tiles = []
    for n in nodes:
        lv, i, j = spatial.node_parts(n)
        k = 1 << (level - lv)
        tiles += [(i * k + x, j * k + y) for x in range(k) for y in range(k)]
    assert sorted(tiles) == [(i, j) for i in range(r0, r1) for j in range(c0, c1)]
