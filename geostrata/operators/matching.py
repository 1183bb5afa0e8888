"""Objects meet many queries at once: the batch form of continuous queries, by four strategies with one result.

A table of queries has query_id, lat_from, lon_from, lat_to, lon_to (null: anywhere), keywords (array, in lower case),
after (date), topic (null: any), grouping, measure, k and, where it isn't left out, closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import texts
from geostrata.functions.spatial import Grid
from geostrata.operators import aggregate, ranges
from geostrata.plans.query import WarehouseQuery
from geostrata.schema import DIMENSIONS, KEY_SEPARATOR, NONE

QUERIES = "query_id bigint, lat_from double, lon_from double, lat_to double, lon_to double, keywords array<string>, after date, topic string, grouping string, measure string, k int, closed boolean"
#: Queries that are broadcast at most; a larger table is left to shuffled joins.
BROADCAST_QUERIES = 200_000
#: Parts that objects are divided into for queries without any key, where those aren't broadcast.
SLOTS = 64
#: Cells of queries, of about their size or smaller.
CELLS = Grid(64, 64)
#: Queries from which those that differ in no more than their rectangles are counted together.
TOGETHER = 64
#: Queries that are counted together at most; their rectangles are broadcast, some 50 bytes each.
TOGETHER_QUERIES = 1_000_000
#: Objects of one key that are put in order in one piece.
PIECE = 1 << 19


def query_table(spark: SparkSession, queries: Iterable[WarehouseQuery]) -> DataFrame:
    """Queries with an interval have no place in it: which objects they count depends on the latest one."""
    corners = lambda r: (r.lat_from, r.lon_from, r.lat_to, r.lon_to) if r else (None,) * 4
    rows = []
    for q in queries:
        if q.interval:
            raise ValueError(f"query {q.query_id} counts the last {q.interval} minutes; register it with the continuous engine")
        rows.append((q.query_id, *corners(q.range), [k.lower() for k in q.keywords], q.after, q.topic, q.group, q.measure, q.k, q.closed))
    return spark.createDataFrame(rows, QUERIES)


def group_key() -> Column:
    """The key of an object under the query's grouping: its levels, joined. A level that the grouping hasn't is not
    computed."""
    levels = [F.when(F.col("q.levels").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"o.{x}")) for i, x in enumerate(DIMENSIONS)]
    return F.when(F.col("q.levels") == 0, F.lit(NONE)).otherwise(F.concat_ws(KEY_SEPARATOR, *levels))


def _residual() -> Column:
    closed = F.col("q.closed")
    below = lambda x, top: (F.col(x) < F.col(top)) | (closed & (F.col(x) == F.col(top)))
    inside = (F.col("o.lat") >= F.col("q.lat_from")) & below("o.lat", "q.lat_to") & (F.col("o.lon") >= F.col("q.lon_from")) & below("o.lon", "q.lon_to")
    words = (F.size("q.keywords") == 0) | (F.size(F.array_except("q.keywords", "o.folded")) == 0)
    after = F.col("q.after").isNull() | (F.col("o.ts") >= F.col("q.after").cast("timestamp"))
    return (F.col("q.lat_from").isNull() | inside) & (F.col("q.topic").isNull() | (F.col("q.topic") == F.col("o.topic"))) & after & words


class _Meeting:
    """Objects, and queries with what the joins need of them. Each kind of query is joined by a key of its own, so every
    join is an equi-join; kinds that no query is of are left out. Queries are broadcast if they are few."""

    def __init__(self, objects: DataFrame, queries: DataFrame):
        self.objects = objects.withColumn("folded", texts.folded_tags(F.col("text")))
        bits = sum((F.when(F.array_contains(F.split("grouping", " "), x), 1 << i).otherwise(0) for i, x in enumerate(DIMENSIONS)), F.lit(0))
        closed = F.coalesce("closed", F.lit(False)) if "closed" in queries.columns else F.lit(False)
        self.queries = queries.withColumns({"levels": bits, "keywords": F.coalesce("keywords", F.array().cast("array<string>")), "closed": closed})
        self.parts: list[DataFrame] = []
        self.kinds = {"topic": F.col("topic").isNotNull(), "word": F.size("keywords") > 0, "place": F.col("lat_from").isNotNull()}
        # one small job tells how many queries there are of each kind
        names = [(t, w, p) for t in (0, 1) for w in (0, 1) for p in (0, 1)]
        each = [F.count_if(reduce(lambda a, b: a & b, (c if on else ~c for c, on in zip(self.kinds.values(), n)))) for n in names]
        self.number = dict(zip(names, self.queries.agg(*each).first()))
        self.few = sum(self.number.values()) <= BROADCAST_QUERIES

    def has(self, **kinds: bool) -> bool:
        return any(n for key, n in self.number.items() if all(bool(key[list(self.kinds).index(k)]) == on for k, on in kinds.items()))

    def join(self, on_objects: Column, on_queries: Column, **kinds: bool) -> None:
        """The queries of some kinds with the objects of the same key. Either key may be an `explode`."""
        if not self.has(**kinds):
            return
        q = self.queries.where(reduce(lambda a, b: a & b, (self.kinds[k] if on else ~self.kinds[k] for k, on in kinds.items()), F.lit(True)))
        q = q.withColumn("join_key", on_queries)
        o = self.objects.withColumn("join_key", on_objects)
        joined = o.alias("o").join((F.broadcast(q) if self.few else q).alias("q"), (F.col("o.join_key") == F.col("q.join_key")) & _residual())
        self.parts.append(joined.select(F.col("q.query_id").alias("query_id"), group_key().alias("key"), "q.measure", "q.k", F.col("o.id").alias("id"), F.col("o.ts").alias("ts"), F.col("o.tags").alias("tags"), F.col("o.lat").alias("lat"), F.col("o.lon").alias("lon")))

    def by_slot(self, **kinds: bool) -> None:
        """Queries that have no key meet all objects: they are sent to every slot, objects to one."""
        slots = 1 if self.few else SLOTS
        own = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))) if slots > 1 else F.pmod(F.xxhash64("query_id"), F.lit(1)).cast("int")
        self.join(F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int"), own, **kinds)

    def by_topic(self, **kinds: bool) -> None:
        self.join(F.col("topic"), F.col("topic"), topic=True, **kinds)

    def by_word(self, **kinds: bool) -> None:
        self.join(F.explode("folded"), F.element_at("keywords", 1), word=True, **kinds)

    def by_place(self, grid: Grid, **kinds: bool) -> None:
        """By topic-or-any and cell: a query is listed for each cell that it touches, an object by its topic and by none."""
        clamp = lambda c, top: F.least(F.greatest(c, F.lit(0)), F.lit(top - 1))
        ends = lambda of, x, top: F.sequence(clamp(of(F.col(f"{x}_from")), top), clamp(of(F.col(f"{x}_to")), top))
        key = lambda topic, r, c: F.struct(topic.isNotNull().alias("some"), F.coalesce(topic, F.lit("")).alias("t"), r.alias("r"), c.alias("c"))
        listed = F.flatten(F.transform(ends(grid.row, "lat", grid.rows), lambda r: F.transform(ends(grid.col, "lon", grid.cols), lambda c: key(F.col("topic"), r, c))))
        row, col = clamp(grid.row(F.col("lat")), grid.rows), clamp(grid.col(F.col("lon")), grid.cols)
        own, none = key(F.coalesce("topic", F.lit("")), row, col), key(F.lit(None).cast("string"), row, col)
        some, rest = self.has(place=True, topic=True), self.has(place=True, topic=False)
        self.join(F.explode(F.array(own, none)) if some and rest else own if some else none, F.explode(listed), place=True, **kinds)

    def result(self) -> DataFrame:
        if not self.parts:
            self.by_slot()
        if not self.parts:  # no queries at all
            empty = self.objects.where("false")
            return empty.select(F.lit(0).cast("bigint").alias("query_id"), F.lit("").alias("key"), F.lit("").alias("measure"), F.lit(0).alias("k"), "id", "ts", "tags", "lat", "lon")
        return reduce(DataFrame.unionByName, self.parts)


def by_scan(objects: DataFrame, queries: DataFrame) -> DataFrame:
    """Every object against every query. For a handful of queries."""
    m = _Meeting(objects, queries)
    m.by_slot()
    return m.result()


def by_topic(objects: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries of a topic meet the objects of it; those without one meet all."""
    m = _Meeting(objects, queries)
    m.by_topic()
    m.by_slot(topic=False)
    return m.result()


def by_keyword(objects: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries meet the objects that have their first keyword; those without one meet all."""
    m = _Meeting(objects, queries)
    m.by_word()
    m.by_slot(word=False)
    return m.result()


def by_cell(objects: DataFrame, queries: DataFrame, grid: Grid = CELLS) -> DataFrame:
    """Queries meet the objects of their topic, or of any, in the cells that they touch; without a range, those that have
    their first keyword; without one, those of their topic. Queries without any of these meet all."""
    m = _Meeting(objects, queries)
    m.by_place(grid)
    m.by_word(place=False)
    m.by_topic(place=False, word=False)
    m.by_slot(place=False, word=False, topic=False)
    return m.result()


STRATEGIES = {"scan": by_scan, "topic": by_topic, "keyword": by_keyword, "cell": by_cell}


def counts(matches: DataFrame) -> DataFrame:
    """(query_id, key, cnt) of the count queries."""
    return matches.where("measure = 'count'").groupBy("query_id", "key").agg(F.count("*").alias("cnt"))


def words(matches: DataFrame) -> DataFrame:
    """(query_id, k, key, term, freq) of the top-k queries, not cut yet, so that batches can be added up."""
    return matches.where("measure = 'topk'").select("query_id", "k", "key", F.explode("tags").alias("term")).groupBy("query_id", "k", "key", "term").agg(F.count("*").alias("freq"))


def best_words(freqs: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, key, term, freq, rnk), each query with its own k. `most` is the largest k, where it is known."""
    most = (freqs.agg(F.max("k")).first()[0] if most is None else most) or 1
    return aggregate.ranked(freqs, ("query_id", "key"), most).where("rnk <= k").select("query_id", "key", "term", "freq", "rnk")


Strategy = Callable[[DataFrame, DataFrame], DataFrame]
_CLASS = ("topic", "keywords", "after", "grouping")


class _Together:
    """Queries of one measure by class: those of a class differ in their rectangles only. In place of the queries the
    classes, without a rectangle, meet the objects by a strategy; what they find is counted by key for all rectangles of
    a class together. Classes of few queries are left to the meeting of objects and queries."""

    def __init__(self, objects: DataFrame, queries: DataFrame, strategy: Strategy, measure: str):
        self.objects, self.strategy, self.spark = objects, strategy, objects.sparkSession
        closed = F.coalesce("closed", F.lit(False)) if "closed" in queries.columns else F.lit(False)
        queries = queries.where(F.col("measure") == measure).withColumns({"keywords": F.coalesce("keywords", F.array().cast("array<string>")), "closed": closed})
        # three small jobs on the queries: what there is, the classes, and their rectangles
        number, named, ids, self.most = queries.agg(F.count("*"), F.count("query_id"), F.count_distinct("query_id"), F.max("k")).first()
        known = queries.groupBy(*_CLASS).agg(F.count("*").alias("n")).where(F.col("n") >= TOGETHER).collect() if number == named <= TOGETHER_QUERIES else []
        self.classes = self.spark.createDataFrame([(i, None, None, None, None, r.keywords, r.after, r.topic, r.grouping, measure, 0, False) for i, r in enumerate(known)], QUERIES)
        #: An id that comes twice is one query, whose counts are those of both.
        self.repeated = ids < named
        self.few, self.rects = queries, {}
        if known:
            numbered = F.broadcast(self.classes.select(F.col("query_id").alias("class"), *(F.col(x).alias(f"c_{x}") for x in _CLASS)))
            same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"c_{x}")) for x in _CLASS))
            self.few = queries.join(numbered, same, "left_anti") if sum(r.n for r in known) < number else None
            own = queries.join(numbered, same).select("class", F.col("query_id").cast("bigint").alias("query_id"), *(F.col(x).cast("double").alias(x) for x in ("lat_from", "lon_from", "lat_to", "lon_to")), "closed", F.col("k").cast("int").alias("k")).toArrow()
            of = own["class"].to_numpy()
            self.rects = {i: ranges.rects(own.filter(of == i)) for i in range(len(known))}

    def found(self, schema: str, run: Callable, *columns: str) -> tuple[DataFrame | None, DataFrame | None]:
        """What `run` (objects of a key, the key, rectangles, whether these are all objects of the key) returns: of the
        classes whose keys are one piece each, which is final, and of the others, which is to be summed up."""
        if not self.rects:
            return None, None
        sizes = self.strategy(self.objects, self.classes).groupBy("query_id", "key").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > PIECE).select("query_id", "key", F.ceil(F.col("n") / PIECE).alias("pieces")).collect()
        split = set(self.rects) if self.repeated else {r.query_id for r in large}
        pieces = self.spark.createDataFrame(large, "query_id bigint, key string, pieces bigint")
        rects = self.spark.sparkContext.broadcast(self.rects)

        def of(classes: set[int], final: bool) -> DataFrame | None:
            if not classes:
                return None
            met = self.strategy(self.objects, self.classes.where(F.col("query_id").isin(*classes))).select("query_id", "key", "id", "lat", "lon", *columns)
            piece = F.lit(0).cast("bigint")
            if large and not final:
                met, piece = met.join(F.broadcast(pieces), ["query_id", "key"], "left"), F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1).cast("bigint")))
            rows = met.select(F.col("query_id").alias("class"), "key", piece.alias("piece"), "lat", "lon", *columns)
            return rows.groupBy("class", "key", "piece").applyInArrow(lambda at, t: run(t, at[1].as_py(), rects.value[at[0].as_py()], final), schema)

        return of(set(self.rects) - split, True), of(split, False)


def counted(objects: DataFrame, queries: DataFrame, strategy: Strategy = by_cell) -> DataFrame:
    """(query_id, key, cnt), as `counts` of what the strategy finds. The work grows with the objects that each class of
    queries meets, and with queries times keys, not with pairs of object and query."""
    t = _Together(objects, queries, strategy, "count")
    final, parts = t.found("query_id bigint, key string, cnt bigint", lambda rows, key, r, final: ranges.counts(rows, key, r))
    few = counts(strategy(objects, t.few)) if t.few is not None else None
    rest = aggregate.merged_counts(parts.unionByName(few) if few is not None else parts, ("query_id", "key")) if parts is not None else few
    return reduce(DataFrame.unionByName, (x for x in (final, rest) if x is not None))


def best_counted(objects: DataFrame, queries: DataFrame, strategy: Strategy = by_cell) -> DataFrame:
    """(query_id, key, term, freq, rnk), as `best_words` of the `words` of what the strategy finds, in the way of `counted`.
    Where all objects of a key are one piece, only the best terms leave it."""
    t = _Together(objects, queries, strategy, "topk")
    final, parts = t.found("query_id bigint, k int, key string, term string, freq bigint, rnk int", ranges.words, "tags")
    few = words(strategy(objects, t.few)) if t.few is not None else None
    if parts is not None:
        parts = parts.drop("rnk").unionByName(few) if few is not None else parts.drop("rnk")
        few = aggregate.merged_counts(parts, ("query_id", "k", "key", "term"), "freq")
    out = [final.drop("k")] if final is not None else []
    return reduce(DataFrame.unionByName, [*out, *([best_words(few, t.most)] if few is not None else [])])
