"""The warehouse as a service: requests come from a stream and results go to another, as do requests for the results of
continuous queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geostrata.plans.parser import QuerySyntaxError, parse_request
from geostrata.plans.query import WarehouseQuery
from geostrata.sources import kafka
from geostrata.streaming.continuous import RESET_ID, ContinuousEngine


class Service:
    """`execute` answers snapshot queries (an executor's method), `engine` keeps the continuous ones, and `deliver` takes
    records (key, value) and the name of a topic; `sources.kafka.deliver` writes them to Kafka.

    A request that can't be read gets a record that says why. A result without rows is delivered as a text that says so.
    Delivery is at least once: a batch that comes again delivers its snapshot results again and registers nothing twice.
    """

    def __init__(self, engine: ContinuousEngine, execute: Callable[[WarehouseQuery], DataFrame], deliver: Callable[[DataFrame, str], None]):
        self.engine, self.execute, self.deliver = engine, execute, deliver

    def _say(self, key: str, text: str, topic: str) -> None:
        self.deliver(self.engine.spark.createDataFrame([(key, text)], "key string, value string"), topic)

    def take_queries(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of requests (column `value`): snapshot queries are answered, continuous ones are registered or taken
        back. Requests are fetched a partition at a time; each is a text that somebody wrote."""
        kept: list[WarehouseQuery] = []
        for r in batch.select("value").toLocalIterator():
            try:
                q = parse_request(r.value)
            except QuerySyntaxError as e:
                self._say("", f"{e}", kafka.SNAPSHOT_RESULTS)
                continue
            if q.continuous or q.query_id == RESET_ID:
                kept.append(q)
            else:
                self.deliver(kafka.records_or_empty(self.execute(q), str(q.query_id)), kafka.SNAPSHOT_RESULTS)
        for said in self.engine.register_batch(kept, batch_id):
            self._say("", said, kafka.CONTINUOUS_RESULTS)

    def take_result_requests(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of ids (column `value`) of continuous queries whose results are wanted now; each is delivered once a
        batch. Ids that aren't registered, and what is no number, are answered as empty."""
        wanted = batch.select(F.trim("value").alias("value")).distinct()
        for r in wanted.toLocalIterator():
            self.publish(r.value)

    def publish(self, query_id: int | str | None = None) -> None:
        """Delivers the result of a continuous query, or of all that are registered."""
        known = self.engine.registered
        for i in known if query_id is None else [query_id]:
            if str(i).lstrip("-").isdigit() and int(i) in known:
                self.deliver(kafka.records_or_empty(self.engine.result(int(i)), str(i)), kafka.CONTINUOUS_RESULTS)
            else:
                self._say(str(i), kafka.EMPTY_RESULT, kafka.CONTINUOUS_RESULTS)

    def take_objects(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of objects, after which the results of all continuous queries are pushed."""
        self.engine.process(batch, batch_id)
        self.publish()

    def start(self, stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 1) -> StreamingQuery:
        """Runs one of the `take_` methods over its stream; without `seconds`, over what there is now."""
        writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
