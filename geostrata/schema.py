"""The data model: messages, objects, the spatial domain and the lattice of groupings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import types as T

LAT_MIN, LAT_MAX = -90.0, 90.0
LON_MIN, LON_MAX = -180.0, 180.0

#: The fourteen tab-separated fields of a message. All are read as strings, so a bad number costs its row, not the read.
MESSAGE_FIELDS = tuple("tid createtime text hashtags tags lat lon placeid placefullname country screenname ulang ulocation timestamp".split())
MESSAGES = T.StructType([T.StructField(name, T.StringType()) for name in MESSAGE_FIELDS])

#: What has to be known of an object; every other column is derived from these.
BASE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("topic", T.StringType()),
    ]
)

SPACE, TIME, TEXT = ("country", "city"), ("month", "week", "day", "hour"), ("topic",)
DIMENSIONS = SPACE + TIME + TEXT
#: Each level with all levels of its dimension that are coarser; week and month can't be derived from each other.
_COARSER = {
    "country": frozenset(),
    "city": frozenset({"country"}),
    "month": frozenset(),
    "week": frozenset(),
    "day": frozenset({"month", "week"}),
    "hour": frozenset({"day", "month", "week"}),
    "topic": frozenset(),
}
NONE, ROOT = "none", "city hour topic"
#: What the values of a group key are joined with where one string is needed.
KEY_SEPARATOR = "\x01"


def group_name(levels: tuple[str, ...]) -> str:
    """The name of a grouping: its levels in the order of the dimensions."""
    return " ".join(x for x in DIMENSIONS if x in levels) or NONE


def levels_of(group: str) -> tuple[str, ...]:
    """The levels of a grouping. `none` has none."""
    if group not in GROUPS:
        raise ValueError(f"not one of the groupings: {group!r}")
    return () if group == NONE else tuple(group.split(" "))


#: All thirty groupings, the finest first.
GROUPS = tuple(group_name((s, t, x)) for x, s, t in product(("topic", ""), ("city", "country", ""), (*TIME[::-1], "")))


def is_ancestor(fine: str, coarse: str) -> bool:
    """Whether an aggregate by `coarse` follows from one by `fine`, which is another grouping."""
    have = levels_of(fine)
    return fine != coarse and all(any(x == y or x in _COARSER[y] for y in have) for x in levels_of(coarse))


def level(group: str) -> int:
    """Steps of one level that a grouping is away from the root of the lattice."""
    depth, front, seen = 0, {ROOT}, {ROOT}
    while group not in front:
        front = {c for g in front for c in children(g)} - seen
        seen |= front
        depth += 1
    return depth


def children(group: str) -> list[str]:
    """The groupings that are one step coarser."""
    below = [g for g in GROUPS if is_ancestor(group, g)]
    return [g for g in below if not any(is_ancestor(h, g) for h in below)]
