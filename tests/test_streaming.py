import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from geostrata.functions.spatial import Rect
from geostrata.operators import matching
from geostrata.operators.retention import latest_hours
from geostrata.plans.executor import execute
from geostrata.plans.query import WarehouseQuery
from geostrata.registry import _messages
from geostrata.sources import kafka, settings
from geostrata.sources.objects import derived, parsed, read_messages, sample_points, stream_messages, write_messages
from geostrata.sources.warehouse import base, objects
from geostrata.streaming import continuous, ingest, service, windows
from tests.compare import SMALL, rows


COLUMNS = "id lat lon text city country hour week".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Messages in two files, and lines that are no messages."""
    path = tmp_path_factory.mktemp("messages") / "m"
    write_messages(_messages(spark, SMALL).coalesce(1), str(path))
    (path / "junk.txt").write_text("a\tb\n" + "\t".join(["1", "", "", "", "x", "north", "0", "", "c", "d", "", "", "", "2024-01-01 00:00:00"]) + "\n" + "\t".join(["9"] * 15) + "\n\n")
    return str(path)


def good(spark):
    return objects(spark, SMALL).where("topic <> 'error'")


def test_messages(spark, folder):
    read = read_messages(spark, folder)
    o = derived(parsed(read, "t"))
    assert rows(o.select(*COLUMNS)) == rows(good(spark).select(*COLUMNS))
    assert o.select("topic").distinct().first()[0] == "t"
    assert read_messages(spark, folder, limit=3).count() == 3
    assert sample_points(read).count() == 1000 and sample_points(read, 0.5).count() < 1000


def test_ingestion(spark, folder, tmp_path):
    stream = parsed(stream_messages(spark, folder, files_per_trigger=1))
    path = str(tmp_path / "o")
    assert ingest.read_objects(spark, path).count() == 0
    for _ in range(2):  # the second run finds nothing new
        ingest.write_objects(stream, path, str(tmp_path / "c"), available_now=True).awaitTermination()
        table = ingest.read_objects(spark, path)
        assert rows(derived(table).select("id", "hour")) == rows(good(spark).select("id", "hour"))
    hours = sorted({r.hour for r in good(spark).select("hour").distinct().collect()})
    assert ingest.retain(spark, path, 10) == hours[-10:]
    assert rows(derived(ingest.read_objects(spark, path)).select("id")) == rows(latest_hours(good(spark)).select("id"))
    again = str(tmp_path / "again")
    ingest.write_objects(stream, again, str(tmp_path / "c2"), available_now=True, keep_hours=3).awaitTermination()
    assert {r.hour for r in derived(ingest.read_objects(spark, again)).select("hour").collect()} == set(hours[-3:])


def parts(spark):
    o = objects(spark, SMALL)
    return o.where("id < 400"), o.where("id >= 400")


def test_engine(spark, tmp_path):
    engine = continuous.ContinuousEngine(spark, str(tmp_path / "p"), "cell")
    first, second = parts(spark)
    q = WarehouseQuery(query_id=5, group="city", range=Rect(-60, -100, 60, 100), sync_seconds=30, order="asc")
    top = WarehouseQuery(query_id=6, group="country", measure="topk", k=2, sync_seconds=60)
    assert "registered" in engine.register(q)
    assert engine.result(5).count() == 0
    engine.process(first, 0)
    engine.register(top)
    engine.process(second, 1)
    engine.process(second, 1)  # the batch runs again
    want = {r.city: r.cnt for r in execute(first.unionByName(second), q).collect()}
    got = engine.result(5).collect()
    assert {r.key: r.cnt for r in got} == want and [r.cnt for r in got] == sorted(want.values())
    late = {(r.country, r.rnk): (r.term, r.freq) for r in execute(second, top).collect()}  # from its registration on
    assert {(r.key, r.rnk): (r.term, r.freq) for r in engine.result(6).collect()} == late
    engine.compact()
    assert not list((tmp_path / "p").glob("batch=*")) and len(list((tmp_path / "p").glob("upto=*"))) == 1
    assert {r.key: r.cnt for r in engine.result(5).collect()} == want
    engine.process(second, 1)  # and again, after it was summed up
    assert {r.key: r.cnt for r in engine.result(5).collect()} == want
    engine.replace(q)
    assert engine.result(5).count() == 0
    assert "removed" in engine.register(q) and list(engine.registered) == [6]
    with pytest.raises(KeyError):
        engine.result(5)
    assert "all" in engine.register(WarehouseQuery(query_id=continuous.RESET_ID)) and not engine.registered
    engine.process(first, 2)
    assert not (tmp_path / "p" / "batch=2").exists()


def test_a_new_engine_goes_on(spark, tmp_path):
    """Queries, versions and partials outlast the engine; a query that came in place of another has only its own counts."""
    first, second = parts(spark)
    make = lambda: continuous.ContinuousEngine(spark, str(tmp_path / "p"), compact_after=2)
    by_city = WarehouseQuery(query_id=5, group="city", range=Rect(-60, -100, 60, 100), keywords=("view",), after=date(2024, 1, 3), sync_seconds=30)
    by_topic = WarehouseQuery(query_id=5, group="topic", sync_seconds=30)
    engine = make()
    engine.register(by_city)
    engine.process(first, 0)
    assert make().registered == {5: by_city}
    engine = make()
    assert {r.key: r.cnt for r in engine.result(5).collect()} == {r.city: r.cnt for r in execute(first, by_city).collect()}
    engine.register(by_city)
    engine.register(by_topic)
    engine = make()
    for k in range(5):
        engine.process(second.where(F.pmod("id", F.lit(5)) == k), k + 1)
    assert len(list((tmp_path / "p").glob("batch=*"))) <= 3
    assert {r.key: r.cnt for r in make().result(5).collect()} == {r.topic: r.cnt for r in execute(second, by_topic).collect()}
    engine.compact()
    left = spark.read.parquet(str(tmp_path / "p" / "upto=5"))
    assert left.select("version").distinct().count() == 1  # the old version's partials are gone


def test_intervals(spark, tmp_path):
    """The last n minutes by the clock, up to that of the latest object, while late objects come and folders are summed up."""
    o = objects(spark, SMALL)
    q = WarehouseQuery(query_id=7, group="country", interval=9_000, sync_seconds=60)
    top = WarehouseQuery(query_id=8, group="none", measure="topk", k=3, interval=9_000, sync_seconds=60)
    engine = continuous.ContinuousEngine(spark, str(tmp_path / "p"))
    engine.register(q)
    engine.register(top)
    assert engine.result(7).count() == 0
    seen = None
    for k in range(4):
        part = o.where(F.pmod("id", F.lit(4)) == k)
        engine.process(part, k)
        seen = part if seen is None else seen.unionByName(part)
        if k == 2:
            engine.compact()
        latest = seen.agg(F.date_trunc("minute", F.max("ts"))).first()[0]
        recent = seen.where(F.date_trunc("minute", "ts") > F.lit(latest) - F.expr("interval 9000 minutes"))
        want = {r.country: r["count"] for r in recent.groupBy("country").count().collect()}
        assert {r.key: r.cnt for r in engine.result(7).collect()} == want and 0 < sum(want.values()) < seen.count()
    assert [(r.term, r.freq) for r in engine.result(8).orderBy("rnk").collect()] == [(r.term, r.freq) for r in execute(recent, WarehouseQuery(measure="topk", k=3)).orderBy("rnk").collect()]
    with pytest.raises(ValueError, match="minutes"):
        matching.query_table(spark, [q])


def test_service(spark, tmp_path):
    """Requests and ids of results in files, objects as batches; all that is delivered is caught."""
    o, sent = objects(spark, SMALL), []
    engine = continuous.ContinuousEngine(spark, str(tmp_path / "p"))
    it = service.Service(engine, lambda q: execute(o, q), lambda records, topic: sent.extend((topic, r.key, r.value) for r in records.collect()))
    world = "-90 -180 90 180"
    requests = [f"SELECT count() FROM data GROUP BY country\n{world}\n21", f"SELECT count() FROM data WHERE text CONTAINS 'nothing of it' GROUP BY city\n{world}\n22", f"SELECT count() FROM data GROUP BY topic SYNC 1 minute\n{world}\n23", "SELECT nothing\nx\ny"]
    batch = spark.createDataFrame([(r,) for r in requests], "value string").coalesce(1)
    it.take_queries(batch, 0)
    snapshot = [json.loads(v) for t, k, v in sent if (t, k) == (kafka.SNAPSHOT_RESULTS, "21")]
    assert {r["country"]: r["cnt"] for r in snapshot} == {r.country: r["count"] for r in o.groupBy("country").count().collect()}
    assert (kafka.SNAPSHOT_RESULTS, "22", kafka.EMPTY_RESULT) in sent and list(engine.registered) == [23]
    assert sum(t == kafka.SNAPSHOT_RESULTS and k == "" for t, k, _ in sent) == 1
    it.take_queries(batch, 0)  # the batch comes again
    assert list(engine.registered) == [23]
    it.publish(23)
    assert sent[-1] == (kafka.CONTINUOUS_RESULTS, "23", kafka.EMPTY_RESULT)
    sent.clear()
    it.take_objects(o, 0)
    want = {r.topic: r["count"] for r in o.groupBy("topic").count().collect()}
    assert {json.loads(v)["key"]: json.loads(v)["cnt"] for t, k, v in sent if (t, k) == (kafka.CONTINUOUS_RESULTS, "23")} == want
    sent.clear()
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids" / "a").write_text("23\n 23\n99\nx\n")
    it.start(spark.readStream.text(str(tmp_path / "ids")), it.take_result_requests, str(tmp_path / "log"), None).awaitTermination()
    assert len(sent) == len(want) + 2 and {k for _, k, v in sent if v == kafka.EMPTY_RESULT} == {"99", "x"}
    it.take_queries(spark.createDataFrame([(f"SELECT count() FROM data\n{world}\n1",)], "value string"), 1)
    assert not engine.registered


def test_sliding_stream_is_the_batch(spark, folder, tmp_path):
    o = derived(parsed(read_messages(spark, folder)))
    want = rows(windows.sliding(o, 30, 10, "country"))
    kept = []
    stream = windows.sliding(derived(parsed(stream_messages(spark, folder))), 30, 10, "country")
    stream.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda d, i: kept.append(rows(d))).start().awaitTermination()
    assert kept[-1] == want
    base_windows = windows.tumbling(o, 10, "country")
    slid = {(r.window_end, r.country): r.cnt for r in windows.sliding(o, 30, 10, "country").collect()}
    rolled = windows.rolling(base_windows, 10, 3, "country").collect()
    assert rolled and all(slid[r.window_end, r.country] == r.cnt for r in rolled)


def test_late_objects_are_dropped(spark, tmp_path):
    """In append mode a window leaves once the watermark has passed it; what comes for it later doesn't count."""
    o = base(spark, SMALL)
    split = o.selectExpr("percentile_approx(ts, 0.5) m").first().m
    for k, part in enumerate((o.where(F.col("ts") >= F.lit(split)), o.where(F.col("ts") < F.lit(split)), o.limit(1))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    got = []

    def run():
        stream = derived(spark.readStream.schema(o.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in2")))
        q = windows.tumbling(stream, 60, "country", "0 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q.foreachBatch(lambda d, i: got.extend(d.collect())).start().awaitTermination()

    (tmp_path / "in2").mkdir()
    for k in range(2):
        (tmp_path / "in" / str(k)).rename(tmp_path / "in2" / str(k))
        run()
    assert got and min(r.window_start for r in got) >= split.replace(minute=0, second=0, microsecond=0)


def test_static_counts_need_no_engine(spark):
    o = objects(spark, SMALL)
    q = WarehouseQuery(query_id=9, group="city")
    assert {r.key: r.cnt for r in continuous.static_counts(o, matching.query_table(spark, [q])).collect()} == {r.city: r.cnt for r in execute(o, q).collect()}


def test_settings_and_records(spark, tmp_path):
    (tmp_path / "s").write_text("# c\n a = b \n\n!x\nnothing\nk=v=w\n")
    assert settings.load(str(tmp_path / "s")) == {"a": "b", "k": "v=w"}
    r = kafka.as_records(spark.createDataFrame([("c", 3)], "city string, cnt long"), "snapshot").first()
    assert (r.key, r.value) == ("snapshot", '{"city":"c","cnt":3}')
    m = kafka.message_records(_messages(spark, SMALL)).first()
    assert len(m.value.split("\t")) == 14 and m.key == str(len(m.value))
    assert kafka.options("h:1", "t")["startingOffsets"] == "latest"
