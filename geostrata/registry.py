"""Registered queries of the engine, over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import spatial, texts, times
from geostrata.functions.spatial import Grid, Rect
from geostrata.functions.stopwords import STOPWORDS
from geostrata.operators import aggregate, lookup, matching, partition, retention, stats
from geostrata.plans import advisor, executor, selected
from geostrata.plans.cubes import GridExecutor, QuadTreeExecutor
from geostrata.plans.parser import parse
from geostrata.plans.query import WarehouseQuery
from geostrata.schema import DIMENSIONS, GROUPS, NONE, levels_of
from geostrata.sources.objects import derived, parsed
from geostrata.sources.warehouse import ORACLE, base, event_stream, objects
from geostrata.storage import new_folder
from geostrata.streaming import continuous, windows

QUARTER, WIDE, NOWHERE, ALIGNED = Rect(0, 0, 45, 90), Rect(-30.5, -60.25, 10.75, 120.5), Rect(10, 10, 10, 10), Rect(-18, -36, 18, 36)
COARSE = Grid(10, 20)
DEPTH = 4
Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT count() FROM data WHERE loc INSIDE r AND time AFTER '2024-01-10' GROUP BY city, day ORDER BY count() desc"
    return executor.execute(objects(spark, sf_dir), parse(sql, WIDE))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _add(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _ORACLES[name] = sql


def _on(name: str, of: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query of the objects; `sql` selects from o."""
    _add(name, lambda spark, sf_dir: of(objects(spark, sf_dir)), sql and ORACLE + sql)


def _in(r: Rect, closed: bool = False) -> str:
    less = "<=" if closed else "<"
    return f"lat >= {r.lat_from} AND lat {less} {r.lat_to} AND lon >= {r.lon_from} AND lon {less} {r.lon_to}"


def _count_sql(group: str, where: str = "true") -> str:
    by = ", ".join(levels_of(group))
    if not by:
        return f"SELECT '{NONE}' AS grouping, count(*) AS cnt FROM o WHERE {where} HAVING count(*) > 0"
    return f"SELECT {by}, count(*) AS cnt FROM o WHERE {where} GROUP BY {by}"


def _topk_sql(group: str, k: int, where: str = "true") -> str:
    by = "".join(f"{x}, " for x in levels_of(group))
    over = f"PARTITION BY {by[:-2]} " if by else ""
    return f"""SELECT {by}term, freq, CAST(rnk AS INTEGER) AS rnk FROM (
      SELECT *, row_number() OVER ({over}ORDER BY freq DESC, term) AS rnk FROM (
        SELECT {by}term, count(*) AS freq FROM (SELECT {by}unnest(tags) AS term FROM o WHERE {where}) GROUP BY ALL)) WHERE rnk <= {k}"""


# the query language
for _g in GROUPS:
    _on(f"count_by_{_g.replace(' ', '_')}", lambda o, g=_g: executor.execute(o, parse("SELECT count() FROM data" + (f" GROUP BY {', '.join(levels_of(g))}" if g != NONE else ""))), _count_sql(_g))

_TAG = "list_contains(list_transform(tags, lambda x: lower(x)), '{}')"
_LANGUAGE: dict[str, tuple[str, Rect | None, str]] = {
    "count_range": ("SELECT count() FROM data WHERE loc INSIDE r GROUP BY city, day", QUARTER, _count_sql("city day", _in(QUARTER))),
    "count_range_wide": ("SELECT count() FROM data WHERE loc INSIDE r GROUP BY country, week, topic", WIDE, _count_sql("country week topic", _in(WIDE))),
    "count_range_empty": ("SELECT count() FROM data WHERE loc INSIDE r", NOWHERE, _count_sql(NONE, _in(NOWHERE))),
    "count_range_aligned": ("SELECT count() FROM data WHERE loc INSIDE r GROUP BY topic", ALIGNED, _count_sql("topic", _in(ALIGNED))),
    "count_keyword": ("SELECT count() FROM data WHERE text CONTAINS 'Click' GROUP BY country", None, _count_sql("country", _TAG.format("click"))),
    "count_keywords_all": ("SELECT count() FROM data WHERE text CONTAINS 'view' AND text CONTAINS 'K3' GROUP BY city", None, _count_sql("city", f"{_TAG.format('view')} AND {_TAG.format('k3')}")),
    "count_keyword_unknown": ("SELECT count() FROM data WHERE text CONTAINS 'android and co' GROUP BY city", None, _count_sql("city", "false")),
    "count_after": ("SELECT count() FROM data WHERE time AFTER '2024-1-10' GROUP BY day", None, _count_sql("day", "date >= DATE '2024-01-10'")),
    "count_all_predicates": (
        "SELECT count(), city FROM data WHERE loc INSIDE r AND text CONTAINS 'building' AND time AFTER '2024-01-10' GROUP BY country, hour ORDER BY count() asc",
        WIDE,
        _count_sql("country hour", f"{_in(WIDE)} AND {_TAG.format('building')} AND date >= DATE '2024-01-10'"),
    ),
    "count_last_minutes": ("SELECT count() FROM data WHERE time AFTER 2000 minute ago GROUP BY city", None, _count_sql("city", "ts > (SELECT max(ts) FROM o) - INTERVAL 2000 MINUTE")),
    "count_order_desc": ("SELECT count() FROM data GROUP BY city ORDER BY city", None, _count_sql("city")),
    "count_order_asc": ("SELECT count() FROM data GROUP BY city, topic ORDER BY count() asc", None, _count_sql("city topic")),
    "topk_none": ("SELECT topk(10) FROM data", None, _topk_sql(NONE, 10)),
    "topk_by_city": ("SELECT topk(3) FROM data GROUP BY city", None, _topk_sql("city", 3)),
    "topk_by_country_day": ("SELECT topk(5) FROM data GROUP BY country, day", None, _topk_sql("country day", 5)),
    "topk_range_keyword": ("SELECT topk(1) FROM data WHERE loc INSIDE r AND text CONTAINS 'click' GROUP BY country, topic", WIDE, _topk_sql("country topic", 1, f"{_in(WIDE)} AND {_TAG.format('click')}")),
}
for _name, (_text, _rect, _sql) in _LANGUAGE.items():
    _on(_name, lambda o, t=_text, r=_rect: executor.execute(o, parse(t, r)), _sql)

_on("count_range_closed", lambda o: executor.execute(o, WarehouseQuery(group="city", range=QUARTER, closed=True)), _count_sql("city", _in(QUARTER, closed=True)))
_on("count_topic", lambda o: executor.execute(o, WarehouseQuery(group="city", topic="click")), _count_sql("city", "topic = 'click'"))
_on("topk_lists", lambda o: aggregate.top_lists(aggregate.topk(o, "country", 5), ("country",)).select("country", F.concat_ws(" ", "terms").alias("terms")), f"SELECT country, string_agg(concat(term, ':', freq), ' ' ORDER BY rnk) AS terms FROM ({_topk_sql('country', 5)}) GROUP BY country")
_on("approximate_topk", lambda o: aggregate.approximate_topk(o, "city", 5))

# aggregates from aggregates
_SETS = ", ".join(f"({', '.join(levels_of(g))})" for g in GROUPS)
_GRP = " + ".join(f"CAST(grouping({x}) AS INTEGER) * {64 >> i}" for i, x in enumerate(DIMENSIONS))
_on("topk_merged", lambda o: aggregate.merged_topk([aggregate.topk_sketch(o.where(F.col("hour") < "2024011500"), "country"), aggregate.topk_sketch(o.where(F.col("hour") >= "2024011500"), "country")], "country", 3), _topk_sql("country", 3))
_on("lattice", lambda o: aggregate.lattice(o), f"SELECT {', '.join(DIMENSIONS)}, {_GRP} AS grp, count(*) AS cnt FROM o GROUP BY GROUPING SETS ({_SETS})")
for _coarse in ("country day", "city week", "country month topic", "none"):
    _on(f"roll_up_to_{_coarse.replace(' ', '_')}", lambda o, g=_coarse: aggregate.roll_up(aggregate.count(o, "city hour topic"), "city hour topic", g, aggregate.countries_of(o)), _count_sql(_coarse))

for _kind, _make in (
    ("grid", lambda o, groups, words: GridExecutor(o, GridExecutor.build(o, COARSE, groups, words), COARSE)),
    ("quadtree", lambda o, groups, words: QuadTreeExecutor(o, QuadTreeExecutor.build(o, DEPTH, groups, words), DEPTH)),
):
    _on(f"cube_{_kind}_count", lambda o, m=_make: m(o, ("city day",), ()).execute(WarehouseQuery(group="city day", range=WIDE)), _count_sql("city day", _in(WIDE)))
    _on(f"cube_{_kind}_aligned", lambda o, m=_make: m(o, ("topic",), ()).execute(WarehouseQuery(group="topic", range=ALIGNED)), _count_sql("topic", _in(ALIGNED)))
    _on(f"cube_{_kind}_ancestor", lambda o, m=_make: m(o, ("city hour topic", "city day"), ()).execute(WarehouseQuery(group="country week", range=WIDE)), _count_sql("country week", _in(WIDE)))
    _on(f"cube_{_kind}_everywhere", lambda o, m=_make: m(o, ("city hour topic",), ()).execute(WarehouseQuery(group="country")), _count_sql("country"))
    _on(f"cube_{_kind}_topk", lambda o, m=_make: m(o, (), ("city",)).execute(WarehouseQuery(measure="topk", k=4, group="country", range=WIDE)), _topk_sql("country", 4, _in(WIDE)))
    _on(f"cube_{_kind}_fallback", lambda o, m=_make: m(o, ("city",), ()).execute(WarehouseQuery(group="city", range=WIDE, keywords=("click",))), _count_sql("city", f"{_in(WIDE)} AND {_TAG.format('click')}"))

# scalars
_FINE = Grid(1000, 1000)


def _row(g: Grid, x: str = "lat") -> str:
    return f"CAST(floor(({x} + 90) / CAST({g.lat_unit!r} AS DOUBLE)) AS INTEGER)"


def _col(g: Grid, x: str = "lon") -> str:
    return f"CAST(floor(({x} + 180) / CAST({g.lon_unit!r} AS DOUBLE)) AS INTEGER)"


def _node(depth: int) -> str:
    g = Grid(1 << depth, 1 << depth)
    return f"CAST({depth << 40} AS BIGINT) + CAST({_row(g)} AS BIGINT) * {1 << 20} + {_col(g)}"


_on("time_parts", lambda o: o.select("id", "year", "month", "week", "day", "hour"), "SELECT id, year, month, week, day, hour FROM o")
_on("time_roll_up", lambda o: o.select("id", *(times.rolled_up(F.col("hour"), "hour", x).alias(x) for x in ("day", "week", "month"))), "SELECT id, day, week, month FROM o")
_on("group_keys", lambda o: o.select("id", F.concat_ws("\x01", "city", "hour", "topic").alias("key")), "SELECT id, concat_ws(chr(1), city, hour, topic) AS key FROM o")
_on("folded_tags", lambda o: o.select("id", F.array_join(texts.folded_tags(F.col("text")), "|").alias("folded")), "SELECT id, array_to_string(list_transform(tags, lambda x: lower(x)), '|') AS folded FROM o")
_on("grid_cells", lambda o: o.select("id", _FINE.cell(F.col("lat"), F.col("lon")).alias("cell")), f"SELECT id, {_row(_FINE)} * 65536 + {_col(_FINE)} AS cell FROM o")
_on("cell_bounds", lambda o: COARSE.with_bounds(o.select("id", COARSE.cell(F.col("lat"), F.col("lon")).alias("cell"))), f"""
    SELECT id, r * 65536 + c AS cell, -90 + r * CAST(18 AS DOUBLE) AS lat_from, -180 + c * CAST(18 AS DOUBLE) AS lon_from, -90 + r * CAST(18 AS DOUBLE) + 18 AS lat_to, -180 + c * CAST(18 AS DOUBLE) + 18 AS lon_to
    FROM (SELECT id, {_row(COARSE)} AS r, {_col(COARSE)} AS c FROM o)""")  # fmt: skip
_on("quadtree_nodes", lambda o: o.select("id", spatial.quadtree_node(F.col("lat"), F.col("lon"), 6).alias("node"), spatial.quadrant(F.col("lat"), F.col("lon"), spatial.WORLD).alias("quadrant")), f"SELECT id, {_node(6)} AS node, CASE WHEN lat < 0 THEN 0 ELSE 1 END + CASE WHEN lon < 0 THEN 0 ELSE 2 END AS quadrant FROM o")
_add(
    "document_terms",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(texts.without_stopwords(texts.terms(F.lower("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("docs")),
    f"""SELECT term, count(*) AS docs FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), ' +$', ''), ' ')) AS term FROM documents WHERE text IS NOT NULL))
        WHERE term NOT IN ({', '.join(f"'{w}'" for w in STOPWORDS)}) GROUP BY term""",
)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw messages: fourteen strings. Every event of the type `error` has an id that isn't a number."""
    rows = base(spark, sf_dir)
    tid = F.when(F.col("topic") == "error", F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    own = {"tid": tid, "tags": F.col("text"), "lat": F.col("lat").cast("string"), "lon": F.col("lon").cast("string"), "placefullname": F.col("city"), "country": F.col("country"), "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}
    from geostrata.schema import MESSAGE_FIELDS

    return rows.select(*(own.get(x, F.lit("")).alias(x) for x in MESSAGE_FIELDS))


_add("parse_messages", lambda s, d: derived(parsed(_messages(s, d))).select("id", "lat", "lon", "text", "country", "city", "week", "hour"), ORACLE + "SELECT id, lat, lon, text, country, city, week, hour FROM o WHERE topic <> 'error'")

# lookups and retention
_on("posting_lists", lambda o: lookup.postings(o).groupBy("term").agg(F.count("*").alias("objects")), "SELECT lower(term) AS term, count(*) AS objects FROM (SELECT unnest(tags) AS term FROM o) GROUP BY lower(term)")
_on("term_lookup", lambda o: lookup.ids_with_words(lookup.postings(o), ("Click", "the", "k3")), f"SELECT id FROM o WHERE {_TAG.format('click')} AND {_TAG.format('k3')}")
_on("term_lookup_stop_words", lambda o: lookup.ids_with_words(lookup.postings(o), ("the", "of")), "SELECT id FROM o WHERE false")
_on("time_bucket_range", lambda o: lookup.find(o, hours=("2024010500", "2024010712")).select("id"), "SELECT id FROM o WHERE hour BETWEEN '2024010500' AND '2024010712'")
_on("find_all", lambda o: lookup.find(o, WIDE, ("view",), ("2024010500", "2024012012")).select("id"), f"SELECT id FROM o WHERE {_in(WIDE)} AND {_TAG.format('view')} AND hour BETWEEN '2024010500' AND '2024012012'")
_on("cell_lookup", lambda o: lookup.in_cell(o, COARSE, 4, 9).select("id"), f"SELECT id FROM o WHERE {_row(COARSE)} = 4 AND {_col(COARSE)} = 9")
_on("leaf_lookup", lambda o: lookup.in_leaves(o, 3, WIDE, (spatial.node_id(3, 3, 4), spatial.node_id(3, 4, 4))).groupBy("node").agg(F.count("*").alias("objects")), f"SELECT {_node(3)} AS node, count(*) AS objects FROM o WHERE {_in(WIDE)} AND {_node(3)} NOT IN ({spatial.node_id(3, 3, 4)}, {spatial.node_id(3, 4, 4)}) GROUP BY 1")
_on("latest_ten_hours", lambda o: retention.latest_hours(o).select("id", "hour"), "SELECT id, hour FROM o WHERE hour IN (SELECT DISTINCT hour FROM o ORDER BY hour DESC LIMIT 10)")

# a workload: one query for each supplier
_WORKLOAD = """, q AS (
  SELECT s_suppkey AS query_id, CAST(s_suppkey * 7919 % 162000 - 90000 AS DOUBLE) / 1000 AS lat_from, CAST(s_suppkey * 104729 % 324000 - 180000 AS DOUBLE) / 1000 AS lon_from,
    CAST(s_suppkey * 7919 % 162000 - 90000 AS DOUBLE) / 1000 + 17.5 AS lat_to, CAST(s_suppkey * 104729 % 324000 - 180000 AS DOUBLE) / 1000 + 35.5 AS lon_to,
    CASE WHEN s_suppkey % 3 = 0 THEN 'click' END AS topic, CASE WHEN s_suppkey % 5 = 0 THEN 'k3' END AS word,
    CASE s_suppkey % 4 WHEN 0 THEN 'country' WHEN 1 THEN 'city day' WHEN 2 THEN 'none' ELSE 'topic' END AS grouping
  FROM supplier)
"""


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    lat, lon = (n * 7919 % 162000 - 90000).cast("double") / 1000, (n * 104729 % 324000 - 180000).cast("double") / 1000
    group = F.when(n % 4 == 0, "country").when(n % 4 == 1, "city day").when(n % 4 == 2, NONE).otherwise("topic")
    word = F.when(n % 5 == 0, F.array(F.lit("k3"))).otherwise(F.array().cast("array<string>"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        n.alias("query_id"), lat.alias("lat_from"), lon.alias("lon_from"), (lat + 17.5).alias("lat_to"), (lon + 35.5).alias("lon_to"), word.alias("keywords"), F.lit(None).cast("date").alias("after"),
        F.when(n % 3 == 0, "click").alias("topic"), group.alias("grouping"), F.lit("count").alias("measure"), F.lit(10).alias("k"),
    )


_CELLS = """, s AS (SELECT query_id, grouping, {r0} AS r0, {c0} AS c0, {r1} AS r1, {c1} AS c1 FROM q), c AS (
  SELECT *, r * 65536 + c AS cell, r IN (r0, r1) OR c IN (c0, c1) AS border FROM (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM s)))
"""
_GRID = Grid(100, 100)


def _cells_sql(g: Grid) -> str:
    return _WORKLOAD + _CELLS.format(r0=_row(g, "lat_from"), c0=_col(g, "lon_from"), r1=_row(g, "lat_to"), c1=_col(g, "lon_to"))


for _which, _cond in (("all", "true"), ("border", "border"), ("inside", "NOT border")):
    _add(f"cells_{_which}", lambda s, d, w=_which: _GRID.cells(workload(s, d), w).select("query_id", "cell"), ORACLE + _cells_sql(_GRID) + f"SELECT query_id, CAST(cell AS INTEGER) AS cell FROM c WHERE {_cond}")

_MATCH = "o.lat >= q.lat_from AND o.lat < q.lat_to AND o.lon >= q.lon_from AND o.lon < q.lon_to AND (q.topic IS NULL OR q.topic = o.topic) AND (q.word IS NULL OR list_contains(list_transform(o.tags, lambda x: lower(x)), q.word))"
_KEY = "CASE q.grouping WHEN 'country' THEN o.country WHEN 'city day' THEN concat(o.city, chr(1), o.day) WHEN 'topic' THEN o.topic ELSE 'none' END"
_MATCH_COUNTS = f"{ORACLE}{_WORKLOAD}SELECT q.query_id, {_KEY} AS key, count(*) AS cnt FROM o JOIN q ON {_MATCH} GROUP BY 1, 2"
for _strategy, _match in matching.STRATEGIES.items():
    _add(f"match_by_{_strategy}", lambda s, d, m=_match: matching.counted(objects(s, d), workload(s, d), m), _MATCH_COUNTS)
_add(
    "match_topk",
    lambda s, d: matching.best_counted(objects(s, d), workload(s, d).withColumns({"measure": F.lit("topk"), "k": F.lit(3)}), partial(matching.by_cell, grid=Grid(10, 10))),
    f"""{ORACLE}{_WORKLOAD}SELECT query_id, key, term, freq, CAST(rnk AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY freq DESC, term) AS rnk FROM (
      SELECT query_id, key, term, count(*) AS freq FROM (SELECT q.query_id, {_KEY} AS key, unnest(o.tags) AS term FROM o JOIN q ON {_MATCH}) GROUP BY ALL)) WHERE rnk <= 3""",
)

# statistics, view selection, partitions
_on("objects_by_cell", lambda o: stats.objects_by_cell(o, COARSE), f"SELECT {_row(COARSE)} AS grid_row, {_col(COARSE)} AS grid_col, count(*) AS objects FROM o GROUP BY 1, 2")
_on("objects_by_node", lambda o: stats.objects_by_node(o, 3), " UNION ALL ".join(f"SELECT {_node(lv)} AS node, count(*) AS objects FROM o GROUP BY 1" for lv in range(4)))
_on("keys_by_cell", lambda o: stats.cardinality(o, "city day", COARSE), f"SELECT {_row(COARSE)} * 65536 + {_col(COARSE)} AS cell, count(*) AS objects, count(DISTINCT (city, day)) AS keys FROM o GROUP BY 1")
_on("keys_by_cell_approximate", lambda o: stats.cardinality(o, "city day", COARSE, approximate=True))
_on("cell_mean_std", lambda o: stats.cell_mean_std(o, COARSE).select("cells", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")), f"""
    SELECT CAST(200 AS BIGINT) AS cells, round(sum(n) / 200.0::DOUBLE, 6) AS mean, round(sqrt(sum(n * n) / 200.0::DOUBLE - (sum(n) / 200.0::DOUBLE) * (sum(n) / 200.0::DOUBLE)), 6) AS std
    FROM (SELECT count(*) AS n FROM o GROUP BY {_row(COARSE)}, {_col(COARSE)})""")  # fmt: skip
_on("busiest_hour", lambda o: stats.busiest_hour(o), "SELECT hour, count(*) AS objects FROM o GROUP BY hour ORDER BY objects DESC, hour LIMIT 1")
_on("index_info", lambda o: stats.index_info(o, 3), f"SELECT hour, count(*) AS leaves, CAST(sum(n) AS BIGINT) AS objects, max(n) AS largest FROM (SELECT hour, {_node(3)} AS node, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY hour")
_on("hours", lambda o: stats.hours(o), "SELECT hour, count(*) AS objects FROM o GROUP BY hour")
_on("draw_hour", lambda o: stats.drawing(o, "2024010500", 3), f"""
    SELECT {_node(3)} AS node, -90 + {_row(Grid(8, 8))} * 22.5::DOUBLE AS lat_from, -180 + {_col(Grid(8, 8))} * 45.0::DOUBLE AS lon_from, -90 + {_row(Grid(8, 8))} * 22.5::DOUBLE + 22.5 AS lat_to,
      -180 + {_col(Grid(8, 8))} * 45.0::DOUBLE + 45 AS lon_to, id, lat, lon FROM o WHERE hour = '2024010500'""")  # fmt: skip
_add("queries_by_cell", lambda s, d: advisor.queries_by_cell(workload(s, d), COARSE), ORACLE + _cells_sql(COARSE) + "SELECT CAST(cell AS INTEGER) AS cell, grouping, count(*) AS queries FROM c GROUP BY ALL")


def _nodes_sql(depth: int) -> str:
    """The nodes of each level up to `depth` that the workload's rectangles enclose."""
    levels = [(lv, Grid(1 << lv, 1 << lv)) for lv in range(depth + 1)]
    cells = "".join(_CELLS.format(r0=_row(g, "lat_from"), c0=_col(g, "lon_from"), r1=_row(g, "lat_to"), c1=_col(g, "lon_to")).replace(" s AS", f" s{lv} AS").replace(" c AS (", f" c{lv} AS (").replace("FROM s)", f"FROM s{lv})") for lv, g in levels)
    union = " UNION ALL ".join(f"SELECT CAST({lv << 40} AS BIGINT) + r * 1048576 + c AS node, grouping FROM c{lv} WHERE NOT border" for lv, _ in levels)
    return f"{ORACLE}{_WORKLOAD}{cells}SELECT CAST(node AS BIGINT) AS node, grouping, count(*) AS queries FROM ({union}) GROUP BY ALL"


_add("queries_by_node", lambda s, d: advisor.queries_by_node(workload(s, d), 5), _nodes_sql(5))
_add("objects_to_check", lambda s, d: stats.objects_to_check(objects(s, d), workload(s, d), COARSE), ORACLE + _cells_sql(COARSE) + f""", n AS (SELECT {_row(COARSE)} * 65536 + {_col(COARSE)} AS cell, count(*) AS n FROM o GROUP BY 1)
    SELECT query_id, CAST(sum(n) AS BIGINT) AS objects FROM c JOIN n USING (cell) WHERE border GROUP BY query_id""")  # fmt: skip
_NAMES = " ".join(f"WHEN {aggregate.id_of(g)} THEN '{g}'" for g in GROUPS)
_COSTS = f""", k AS (SELECT cell, CASE grp {_NAMES} END AS grouping, CAST(sum(n) AS BIGINT) AS objects, count(*) AS cardinality FROM (
      SELECT cell, {_GRP} AS grp, count(*) AS n FROM (SELECT *, {_row(COARSE)} * 65536 + {_col(COARSE)} AS cell FROM o) GROUP BY GROUPING SETS ({', '.join(f"({', '.join(('cell', *levels_of(g)))})" for g in GROUPS)})) GROUP BY cell, grp),
  p AS (SELECT cell, grouping, count(*) AS queries FROM c GROUP BY ALL),
  v AS (SELECT k.cell, k.grouping, objects, cardinality, coalesce(queries, 0) AS queries FROM k LEFT JOIN p ON k.cell = p.cell AND k.grouping = p.grouping)
"""
_add("view_candidates", lambda s, d: advisor.candidates(objects(s, d), workload(s, d), COARSE), ORACLE + _cells_sql(COARSE) + _COSTS + "SELECT *, objects + cardinality * queries AS with_view, queries * objects AS without_view, queries > 0 AND objects + cardinality * queries < queries * objects AS worth_it FROM v")
_add("region_loads", lambda s, d: advisor.region_loads(advisor.candidates(objects(s, d), workload(s, d), COARSE), "cell"), ORACLE + _cells_sql(COARSE) + _COSTS + "SELECT cell, CAST(max(objects) + sum(least(objects + cardinality * queries, queries * objects)) AS BIGINT) AS load FROM v GROUP BY cell")


def _selected_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = advisor.collected(advisor.candidates(objects(spark, sf_dir), workload(spark, sf_dir), COARSE), "cell")
    return spark.createDataFrame(advisor.select_views(found, budget=2_000), "cell int, grouping string")


def _routed(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, g = objects(spark, sf_dir), Grid(64, 64)
        leaves = partition.PARTITIONERS[name](partition.load_array(stats.objects_by_cell(o, g), g), 8)
        return partition.partition_info(o, leaves, g)

    return run


_add("select_views", _selected_views)


def _from_selected(spark: SparkSession, sf_dir: str, q: WarehouseQuery, nodes: bool = False) -> DataFrame:
    """The advisor chooses views for the workload, they are stored, and a query is answered from them."""
    o, path = objects(spark, sf_dir), new_folder(spark, "views")
    costs = advisor.node_candidates(o, workload(spark, sf_dir), DEPTH) if nodes else advisor.candidates(o, workload(spark, sf_dir), COARSE)
    found = advisor.collected(costs, "node" if nodes else "cell")
    places = selected.NodePlaces(DEPTH) if nodes else selected.GridPlaces(COARSE)
    selected.SelectedViews.build(o, places, advisor.select_views(found, budget=20_000), advisor.select_views(found, 80_000, advisor.WORD_ROWS)).save(path)
    return selected.SelectedExecutor(o, selected.SelectedViews.load(spark, path), places).execute(q)


for _kind, _by_node in (("grid", False), ("quadtree", True)):
    _add(f"cube_{_kind}_selected", lambda s, d, n=_by_node: _from_selected(s, d, WarehouseQuery(group="topic", range=WIDE), n), ORACLE + _count_sql("topic", _in(WIDE)))
    _add(f"cube_{_kind}_selected_everywhere", lambda s, d, n=_by_node: _from_selected(s, d, WarehouseQuery(group="country"), n), ORACLE + _count_sql("country"))
    _add(f"cube_{_kind}_selected_topk", lambda s, d, n=_by_node: _from_selected(s, d, WarehouseQuery(measure="topk", k=4, group="country", range=WIDE), n), ORACLE + _topk_sql("country", 4, _in(WIDE)))
for _name in partition.PARTITIONERS:
    _add(f"router_{_name.replace('.', '_').replace('-', '')}", _routed(_name))
_on("router_random", lambda o: o.groupBy(partition.random_partition(8).alias("partition")).agg(F.count("*").alias("objects")))

# streams
_CONTINUOUS = (
    WarehouseQuery(query_id=11, group="city", range=WIDE, sync_seconds=60),
    WarehouseQuery(query_id=12, group="country day", keywords=("view",), sync_seconds=60),
    WarehouseQuery(query_id=13, topic="click", after=date(2024, 1, 10), sync_seconds=60),
    WarehouseQuery(query_id=14, measure="topk", k=3, group="country", range=QUARTER, sync_seconds=60),
)


def _finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream over all files there are has in the end."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    last = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/{batch_id}")
        last.append(batch_id)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/result/{max(last)}")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(base(spark, sf_dir, event_stream(spark, sf_dir)))


def _stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(continuous.static_counts(_stream(spark, sf_dir), matching.query_table(spark, _CONTINUOUS)))


_RECENT = WarehouseQuery(query_id=15, group="city", interval=20_000, range=WIDE, sync_seconds=60)


def _engine(spark: SparkSession, sf_dir: str, queries: tuple[WarehouseQuery, ...], restart: bool = False) -> continuous.ContinuousEngine:
    folder = new_folder(spark, "continuous")
    engine = continuous.ContinuousEngine(spark, f"{folder}/partials")
    for q in queries:
        engine.register(q)
    engine.start(_stream(spark, sf_dir), f"{folder}/log", available_now=True).awaitTermination()
    if restart:
        engine.compact()
        engine = continuous.ContinuousEngine(spark, f"{folder}/partials")
    return engine


_CONTINUOUS_SQL = f"""SELECT CAST(11 AS BIGINT) AS query_id, city AS key, count(*) AS cnt FROM o WHERE {_in(WIDE)} GROUP BY city
  UNION ALL SELECT 12, concat(country, chr(1), day), count(*) FROM o WHERE {_TAG.format('view')} GROUP BY country, day
  UNION ALL SELECT 13, 'none', count(*) FROM o WHERE topic = 'click' AND date >= DATE '2024-01-10' HAVING count(*) > 0"""
_SLIDE = """SELECT strftime(w + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, country, count(*) AS cnt
  FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * unnest(range(6)) AS w, country FROM o) GROUP BY ALL"""
_text_time = lambda df, c: df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))

_add("stream_continuous_count", _stream_counts, ORACLE + _CONTINUOUS_SQL)
_add("stream_continuous_topk", lambda s, d: _engine(s, d, _CONTINUOUS).result(14).select("key", "term", "freq", "rnk"), ORACLE + _topk_sql("country", 3, _in(QUARTER)).replace("SELECT country, term, freq", "SELECT country AS key, term, freq", 1))
_LAST_MINUTES = f"date_trunc('minute', ts) > (SELECT date_trunc('minute', max(ts)) FROM o) - INTERVAL {_RECENT.interval} MINUTE"
_add("stream_continuous_interval", lambda s, d: _engine(s, d, (*_CONTINUOUS, _RECENT)).result(15), ORACLE + f"SELECT city AS key, count(*) AS cnt FROM o WHERE {_in(WIDE)} AND {_LAST_MINUTES} GROUP BY city")
_add("stream_continuous_restart", lambda s, d: _engine(s, d, _CONTINUOUS, restart=True).result(11), ORACLE + f"SELECT city AS key, count(*) AS cnt FROM o WHERE {_in(WIDE)} GROUP BY city")
_add("stream_sliding_count", lambda s, d: _text_time(_finished(windows.sliding(_stream(s, d), 60, 10, "country")), "window_end"), ORACLE + _SLIDE)
_on("sliding_count", lambda o: _text_time(windows.sliding(o, 60, 10, "country"), "window_end"), _SLIDE)
_on("tumbling_count", lambda o: _text_time(windows.tumbling(o, 10, "topic"), "window_start"), "SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, topic, count(*) AS cnt FROM o GROUP BY ALL")
_on("rolling_count", lambda o: _text_time(windows.rolling(windows.tumbling(o, 10, "country"), 10, 6, "country"), "window_end"), """
    SELECT strftime(w + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, country, CAST(sum(n) OVER (PARTITION BY country ORDER BY w RANGE BETWEEN INTERVAL 50 MINUTE PRECEDING AND CURRENT ROW) AS BIGINT) AS cnt
    FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS w, country, count(*) AS n FROM o GROUP BY ALL)""")  # fmt: skip
_on("coarser_windows", lambda o: _text_time(windows.coarser(windows.tumbling(o, 10, "topic"), 60, "topic"), "window_start"), "SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, topic, count(*) AS cnt FROM o GROUP BY ALL")
