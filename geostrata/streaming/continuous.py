"""Continuous queries: each counts objects from its registration on, and can be asked at any time."""

from __future__ import annotations

import json
import threading
from dataclasses import asdict
from dataclasses import replace as dataclass_replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geostrata.functions.spatial import Rect
from geostrata.operators import aggregate, matching
from geostrata.plans.query import WarehouseQuery
from geostrata.storage import Folder

RESET_ID = 1
PARTIALS = "query_id bigint, version int, k int, key string, term string, minute timestamp, n bigint"
#: The row of a batch that says how late it is by its latest object.
LATEST = -1
#: Batches whose partials are merged into one table.
COMPACT_AFTER = 100


def static_counts(stream: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, cnt) of a fixed table of queries as one streaming aggregation: for `complete` or `update` mode."""
    return matching.counts(matching.by_cell(stream, queries))


def _marked(latest: DataFrame) -> DataFrame:
    """The row of partials that holds the minute of the latest object, if there is one."""
    return latest.where("minute is not null").selectExpr(f"cast({LATEST} as bigint) as query_id", "0 as version", "cast(null as int) as k", "'' as key", "cast(null as string) as term", "minute", "0L as n")


def _as_json(q: WarehouseQuery) -> dict:
    return {**asdict(q), "after": q.after and q.after.isoformat()}


def _from_json(x: dict) -> WarehouseQuery:
    r = x["range"]
    return WarehouseQuery(**{**x, "range": r and Rect(**r), "keywords": tuple(x["keywords"]), "after": x["after"] and date.fromisoformat(x["after"])})


class ContinuousEngine:
    """Queries that come and go while a stream runs.

    Each micro-batch meets the queries that are registered when it begins, and leaves its partial counts in a folder of its
    own. A batch that is run again after a failure replaces that folder, so each object counts once. A result is the sum
    of the partials of a query's current version. `compact` sums folders up and drops what belongs to no query any more;
    it runs by itself after every COMPACT_AFTER batches, so a result reads a bounded number of folders.

    What is registered is a file beside the partials, changed as a whole: a new engine on the folder goes on with the
    queries and versions of the old one. One engine at a time writes to a folder.

    A query about the last n minutes keeps its partials by the minute: it counts the n minutes (by the clock) up to that
    of the latest object that the engine has seen, late objects included. Minutes that have passed go when folders are
    summed up.
    """

    def __init__(self, spark: SparkSession, folder: str, strategy: str = "cell", compact_after: int = COMPACT_AFTER):
        self.spark, self.folder, self.match, self.compact_after = spark, folder, matching.STRATEGIES[strategy], compact_after
        self._files = Folder(spark, folder)
        self._lock = threading.Lock()
        self._queries: dict[int, tuple[int, WarehouseQuery]] = {}
        self._versions, self._intake = 0, -1
        if self._files.names("registry.json"):
            state = json.loads(self._files.read("registry.json"))
            self._versions, self._intake = state["versions"], state["intake"]
            self._queries = {q["query_id"]: (v, _from_json(q)) for v, q in state["queries"]}

    def _save(self) -> None:
        self._files.write("registry.json", json.dumps({"versions": self._versions, "intake": self._intake, "queries": [[v, _as_json(q)] for v, q in self._queries.values()]}))

    def _register(self, q: WarehouseQuery) -> str:
        if q.query_id < 0:
            raise ValueError("a query's id isn't negative")
        if q.query_id == RESET_ID:
            self._queries.clear()
            return "all queries were removed"
        if q.query_id in self._queries:
            del self._queries[q.query_id]
            return f"query {q.query_id} was removed"
        self._versions += 1
        self._queries[q.query_id] = (self._versions, q)
        return f"query {q.query_id} was registered"

    def register(self, q: WarehouseQuery) -> str:
        """A new query is added, an id that is known is taken back, and the id 1 takes all back. Returns what was done."""
        with self._lock:
            said = self._register(q)
            self._save()
            return said

    def register_batch(self, queries: list[WarehouseQuery], batch_id: int) -> list[str]:
        """The queries of a micro-batch of a stream of queries, in their order. A batch that comes again does nothing, as
        registering a query twice would take it back."""
        with self._lock:
            if batch_id <= self._intake:
                return []
            said = [self._register(q) for q in queries]
            self._intake = batch_id
            self._save()
            return said

    def replace(self, q: WarehouseQuery) -> None:
        """A query in place of one with its id; it starts from nothing."""
        with self._lock:
            self._versions += 1
            self._queries[q.query_id] = (self._versions, q)
            self._save()

    @property
    def registered(self) -> dict[int, WarehouseQuery]:
        with self._lock:
            return {i: q for i, (_, q) in self._queries.items()}

    def _counted(self, batch: DataFrame, queries: list[WarehouseQuery], recent: bool) -> DataFrame:
        """Partials of queries without an interval, or of those with one by the minute."""
        found = self.match(batch, matching.query_table(self.spark, [dataclass_replace(q, interval=0) for q in queries]))
        found = found.withColumn("minute", F.date_trunc("minute", "ts") if recent else F.lit(None).cast("timestamp"))
        counts = found.where("measure = 'count'").groupBy("query_id", "key", "minute").agg(F.count("*").alias("n"))
        words = found.where("measure = 'topk'").select("query_id", "k", "key", "minute", F.explode("tags").alias("term")).groupBy("query_id", "k", "key", "term", "minute").agg(F.count("*").alias("n"))
        return counts.withColumns({"k": F.lit(None).cast("int"), "term": F.lit(None).cast("string")}).unionByName(words)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of objects with their derived columns."""
        with self._lock:
            now = dict(self._queries)
        if not now:
            return
        plain, recent = ([q for _, q in now.values() if bool(q.interval) == on] for on in (False, True))
        parts = [self._counted(batch, qs, on) for qs, on in ((plain, False), (recent, True)) if qs]
        versions = self.spark.createDataFrame([(i, v) for i, (v, _) in now.items()], "query_id bigint, version int")
        versions = F.broadcast(versions) if len(now) <= matching.BROADCAST_QUERIES else versions
        out = reduce(DataFrame.unionByName, parts).join(versions, "query_id").select("query_id", "version", "k", "key", "term", "minute", "n")
        if recent:
            out = out.unionByName(_marked(batch.agg(F.max(F.date_trunc("minute", "ts")).alias("minute"))))
        out.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        if len(self._files.names("batch=*")) > self.compact_after:
            self.compact(batch_id - 1)

    def start(self, objects: DataFrame, checkpoint: str, available_now: bool = False, seconds: int | None = None) -> StreamingQuery:
        """Runs over a stream of objects; by default as often as the most frequent query asks for."""
        every = seconds or min((q.sync_seconds for q in self.registered.values() if q.sync_seconds), default=60)
        writer = objects.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{every} seconds")).start()

    def _tables(self) -> tuple[int, list[str]]:
        """The last batch that is summed up (-1: none), and what there is to read: the sums up to it, and the batches after it."""
        number = lambda x: int(x.split("/")[0].split("=")[1])
        sums = self._files.names("upto=*/_SUCCESS")
        done = max(map(number, sums), default=-1)
        batches = [x.split("/")[0] for x in self._files.names("batch=*/_SUCCESS") if number(x) > done]
        return done, [*([f"upto={done}"] if done >= 0 else []), *batches]

    def _partials(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], PARTIALS)
        return self.spark.read.schema(PARTIALS).parquet(*(f"{self.folder}/{x}" for x in names))

    def result(self, query_id: int) -> DataFrame:
        """(key, cnt), in the query's order, or (key, term, freq, rnk). Raises KeyError for an id that isn't registered."""
        with self._lock:
            version, q = self._queries[query_id]
        partials = self._partials(self._tables()[1])
        own = partials.where((F.col("query_id") == query_id) & (F.col("version") == version))
        if q.interval:
            latest = partials.where(F.col("query_id") == LATEST).agg(F.max("minute")).first()[0]
            own = own.where(F.col("minute") > F.lit(latest).cast("timestamp") - F.expr(f"interval {int(q.interval)} minutes"))
        if q.measure == "topk":
            freqs = own.groupBy("key", "term").agg(F.sum("n").alias("freq"))
            return aggregate.ranked(freqs, ("key",), q.k)
        counts = own.groupBy("key").agg(F.sum("n").alias("cnt"))
        return counts.orderBy(F.asc("cnt") if q.order == "asc" else F.desc("cnt"), "key")

    def compact(self, upto: int | None = None) -> None:
        """Sums up the partials of the batches up to one, by default of all there are, and removes their folders. What belongs
        to a query that was taken back, and minutes that have left all intervals, are not carried on.

        The sums are complete before anything is removed, and results read batches after them only: a failure in between
        leaves folders that no result reads, and that the next time removes.
        """
        done, names = self._tables()
        number = lambda x: int(x.split("=")[1])
        names = [x for x in names if x.startswith("upto=") or upto is None or number(x) <= upto]
        last = max((number(x) for x in names if x.startswith("batch=")), default=done)
        if last > done:
            with self._lock:
                live = dict(self._queries)
            partials = self._partials(names)
            latest = partials.where(F.col("query_id") == LATEST).agg(F.max("minute").alias("minute"))
            sums = partials.where(F.lit(False))
            if live:
                rows = [(i, v, q.interval) for i, (v, q) in live.items()]
                known = self.spark.createDataFrame(rows, "query_id bigint, version int, interval int")
                keep = partials.join(F.broadcast(known) if len(rows) <= matching.BROADCAST_QUERIES else known, ["query_id", "version"])
                gone = F.col("minute") <= F.lit(latest.first()[0]).cast("timestamp") - F.make_interval(mins=F.col("interval"))
                keep = keep.where(F.col("minute").isNull() | ~gone)
                sums = keep.groupBy("query_id", "version", "k", "key", "term", "minute").agg(F.sum("n").alias("n"))
            sums = sums.unionByName(_marked(latest))
            sums.write.mode("overwrite").parquet(f"{self.folder}/upto={last}")
        for x in self._files.names("batch=*") + self._files.names("upto=*"):
            if number(x) < last or (number(x) == last and x.startswith("batch=")):
                self._files.remove(x)
