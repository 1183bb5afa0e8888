from datetime import date

import pytest

from geostrata.functions.spatial import Rect
from geostrata.plans.parser import QuerySyntaxError, parse, parse_fields, parse_request, request
from geostrata.plans.query import WarehouseQuery
from geostrata.schema import GROUPS, ROOT, children, is_ancestor, level, levels_of

R = Rect(12.5, -70.25, 30.75, 8.125)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT count(), x FROM d WHERE Loc INSIDE R    GROUP    by day  ", {"group": "day", "range": R}),
        ("SELECT count(10), x FROM d ", {}),
        ("select COUNT() from d group by CITY", {"group": "city"}),
        ("SELECT count() FROM d WHERE TEXT CONTAINS 'ONE' and text contains 'two'", {"keywords": ("one", "two")}),
        ("SELECT count() FROM d WHERE text contains two GROUP BY city, hour order by count() asc", {"keywords": ("two",), "group": "city hour", "order": "asc", "order_column": "count"}),
        ("SELECT count() FROM d GROUP by day,,  country", {"group": "country day"}),
        ("SELECT count() FROM d GROUP by moon,  country  order by moon desc", {"group": "country", "order": "desc", "order_column": "moon"}),
        ("SELECT topk(10), city FROM d GROUP by topic order by text ASC", {"measure": "topk", "k": 10, "group": "topic"}),
        ("SELECT topxk(20), count() FROM d GROUP by country, hour", {"group": "country hour"}),
        ("SELECT topk(5) FROM d WHERE loc inside r AND time AFTER '2019-11-02' GROUP by hour", {"measure": "topk", "k": 5, "range": R, "after": date(2019, 11, 2), "group": "hour"}),
        ("SELECT topk(9) FROM d WHERE time AFTER '2019-10-1' GROUP by hour sync   1    hour", {"measure": "topk", "k": 9, "after": date(2019, 10, 1), "group": "hour", "sync_seconds": 3600}),
        ("SELECT count() FROM d WHERE text contains 'key' sync 2 minutes", {"keywords": ("key",), "sync_seconds": 120}),
        ("SELECT count() FROM d WHERE text contains 'android' AND text contains 'rock and roll'", {"keywords": ("android", "rock and roll")}),
        ("SELECT count() FROM d WHERE text contains 'group by'", {"keywords": ("group by",)}),
        ("SELECT count() FROM d WHERE time after 10 minute ago", {"interval": 10}),
        ("SELECT count() FROM d GROUP BY city ORDER BY count()", {"group": "city", "order": "desc", "order_column": "count"}),
        ("SELECT count() FROM d ORDER BY count() asc", {}),
        ("SELECT count()\nFROM d\nGROUP BY *", {}),
    ],
)
def test_valid(text, want):
    assert parse(text, R) == WarehouseQuery(**want)


@pytest.mark.parametrize(
    "text",
    [
        "count() FROM d GROUP by country",
        "sele cT count() FROM d",
        "SELECT city FROM d",
        "SELECT count(), topk(3) FROM d",
        "SELECT topk() FROM d",
        "SELECT topk(0) FROM d",
        "SELECT count() FROM d GROUP by country sync 1 day",
        "SELECT count() FROM d GROUP by country, city",
        "SELECT count() FROM d GROUP by country city",
        "SELECT count() FROM d GROUP by moon",
        "SELECT count() FROM d WHERE moon INSIDE r",
        "SELECT count() FROM d WHERE time AFTER '2019-13-40'",
        "SELECT count() FROM d loc inside r GROUP by city",
        "SELECT count() FROM d GROUP by city WHERE loc inside r",
        "",
    ],
)
def test_invalid(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_lenient():
    q = parse("selecT count(10) FROM d loc INSIDE r GROUP by city, hour order by date ASC", R, lenient=True)
    assert (q.group, q.range, q.order) == ("city hour", None, "asc")
    assert parse("SELECT count() FROM d WHERE moon is full AND loc inside r", R, lenient=True).range == R


def test_request():
    q = parse_request("SELECT count(), city FROM d\nWHERE loc INSIDE r GROUP BY city\n12.5 -70.25 30.75 8.125\n7")
    assert q == WarehouseQuery(group="city", range=R, query_id=7)
    assert "group by: city" in q.describe() and "-70.25" in q.describe()
    for bad in ("SELECT count() FROM d", "SELECT count() FROM d\n1 2 3\n4", "SELECT count() FROM d\n1 2 3 4\nx"):
        with pytest.raises(QuerySyntaxError):
            parse_request(bad)


def test_fields():
    q = parse_fields("measure:topk(3)\tgroup by:city day\trange:1,2,3,4\tkeywords:A b")
    assert q == WarehouseQuery(measure="topk", k=3, group="city day", range=Rect(1, 2, 3, 4), keywords=("a", "b"))
    assert parse_fields("measure:count") == WarehouseQuery()
    with pytest.raises(QuerySyntaxError):
        parse_fields("measure:sum")


def test_lattice():
    assert len(GROUPS) == len(set(GROUPS)) == 30
    assert is_ancestor("city hour", "country day") and is_ancestor("day", "week") and is_ancestor("topic", "none") and is_ancestor("city", "country")
    assert not is_ancestor("week", "month") and not is_ancestor("country", "city") and not is_ancestor("city", "city")
    assert all(is_ancestor(ROOT, g) for g in GROUPS if g != ROOT)
    assert set(children("day")) == {"month", "week"} and set(children("city hour")) == {"country hour", "city day"}
    assert (level(ROOT), level("city hour"), level("country day topic"), level("none")) == (0, 1, 2, 6)
    with pytest.raises(ValueError):
        levels_of("city country")


@pytest.mark.parametrize(
    "q",
    [
        WarehouseQuery(query_id=3),
        WarehouseQuery(measure="topk", k=4, group="city hour topic", range=Rect(-1.5, 2, 3.25, 4), keywords=("key one", "k2"), after=date(2024, 1, 10), sync_seconds=90, query_id=12),
        WarehouseQuery(group="country week", interval=30, order="asc", order_column="count", query_id=5),
    ],
)
def test_requests_are_read_as_they_were_meant(q):
    assert parse_request(request(q)) == q


def test_what_a_request_cannot_say():
    for q in (WarehouseQuery(topic="click"), WarehouseQuery(keywords=("it's",)), WarehouseQuery(closed=True)):
        with pytest.raises(ValueError, match="can't say"):
            request(q)
