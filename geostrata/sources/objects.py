"""Messages to objects: parsing, and the columns that are derived from the base ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import texts, times
from geostrata.schema import MESSAGE_FIELDS, MESSAGES, TIME


def derived(base: DataFrame) -> DataFrame:
    """Objects with their derived columns. Those that a query doesn't use cost nothing: Catalyst drops them."""
    parts = {x: times.part(F.col("ts"), x) for x in ("year", *TIME)}
    return base.withColumns({"date": F.to_date("ts"), **parts, "tags": texts.tags(F.col("text"))})


def parsed(messages: DataFrame, topic: str | None = None) -> DataFrame:
    """Objects of raw messages (fourteen string columns), batch or stream. Messages whose id, place or time can't be read
    are left out. The tags are what the engine calls text, the full name of the place is the city."""
    base = messages.select(
        F.expr("try_cast(tid as bigint)").alias("id"),
        F.expr("try_cast(lat as double)").alias("lat"),
        F.expr("try_cast(lon as double)").alias("lon"),
        F.coalesce("tags", F.lit("")).alias("text"),
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        "country",
        F.col("placefullname").alias("city"),
        F.lit(topic).cast("string").alias("topic"),
    )
    return base.where("id is not null and lat is not null and lon is not null and ts is not null")


def _split(lines: DataFrame) -> DataFrame:
    """Only lines of exactly fourteen fields are messages."""
    cells = F.split("value", "\t", -1)
    rows = lines.select(cells.alias("f")).where(F.size("f") == len(MESSAGE_FIELDS))
    return rows.select(*(F.col("f")[i].alias(name) for i, name in enumerate(MESSAGE_FIELDS)))


def read_messages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw messages of tab-separated files; `limit` is for samples."""
    rows = _split(spark.read.text(path))
    return rows if limit is None else rows.limit(limit)


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Raw messages of the files that arrive in a folder; `files_per_trigger` throttles."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _split(reader.text(path))


def sample_points(messages: DataFrame, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """(lat, lon) of a share of the messages; what isn't a number is left out."""
    points = messages.select(F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lon")).where("lat is not null and lon is not null")
    return points if fraction >= 1 else points.sample(fraction, seed)


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Raw messages as tab-separated files, for another engine's folder stream."""
    messages.select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in MESSAGES.names)).alias("value")).write.mode(mode).text(path)
