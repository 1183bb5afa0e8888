"""Kafka topics. The connector's jar is a deployment matter (`--packages org.apache.spark:spark-sql-kafka-0-10`);
without it Spark raises when a stream starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.schema import MESSAGE_FIELDS

OBJECT_TOPIC, QUERY_TOPIC, RESULT_REQUEST_TOPIC = "object", "query", "continuous-query"
SNAPSHOT_RESULTS, CONTINUOUS_RESULTS = "query-result", "continuous-query-result"
EMPTY_RESULT = "Empty result set"


def options(servers: str, topic: str, offsets: str = "latest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets}


def stream(spark: SparkSession, servers: str, topic: str = OBJECT_TOPIC, offsets: str = "latest") -> DataFrame:
    """The values of a topic as a streaming column `value`; split into messages by `sources.objects`."""
    return spark.readStream.format("kafka").options(**options(servers, topic, offsets)).load().select(F.col("value").cast("string").alias("value"))


def as_records(result: DataFrame, key: str) -> DataFrame:
    """Rows of a result as the key and value columns that the Kafka sink takes; the value is JSON."""
    return result.select(F.lit(key).alias("key"), F.to_json(F.struct(*result.columns)).alias("value"))


def message_records(messages: DataFrame) -> DataFrame:
    """Raw messages (batch or stream) as records of the object topic: the tab-separated line, with its length as the key. The
    rate is that of the stream that they come from (`files_per_trigger` and the trigger)."""
    line = F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in MESSAGE_FIELDS))
    return messages.select(F.length(line).cast("string").alias("key"), line.alias("value"))


def records_or_empty(result: DataFrame, key: str) -> DataFrame:
    """The records of a result or, if it has no rows, one that says so."""
    empty = result.sparkSession.createDataFrame([(key, EMPTY_RESULT)], "key string, value string")
    return empty if result.isEmpty() else as_records(result, key)


def deliver(servers: str) -> Callable[[DataFrame, str], None]:
    """What `streaming.service` sends records to: the topics of a Kafka cluster."""
    return lambda records, topic: records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write(result: DataFrame, servers: str, topic: str, key: str) -> None:
    deliver(servers)(records_or_empty(result, key), topic)


def console(df: DataFrame, checkpoint: str):
    """A debugging sink: prints what comes in."""
    return df.writeStream.format("console").option("checkpointLocation", checkpoint).start()
