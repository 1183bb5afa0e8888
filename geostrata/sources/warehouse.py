"""Objects of the star schema: each event gets a place from its numbers, and its user's customer, nation and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources.objects import derived

#: The same in DuckDB, with the derived columns; queries of the registry select from `o`.
ORACLE = """
WITH b AS (
  SELECT e.event_id AS id, CAST((e.event_id * 7919 + e.user_id * 104729) % 180000 - 90000 AS DOUBLE) / 1000 AS lat,
    CAST((e.event_id * 15485863 + e.user_id * 32452843) % 360000 - 180000 AS DOUBLE) / 1000 AS lon,
    concat(e.event_type, ',K', CAST(CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) % 10 AS VARCHAR), ',', c.c_mktsegment) AS text,
    e.ts, r.r_name AS country, n.n_name AS city, e.event_type AS topic
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
o AS (
  SELECT *, CAST(ts AS DATE) AS date, strftime(ts, '%Y') AS year, strftime(ts, '%Y%m') AS month, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y%m%d%H') AS hour,
    concat(strftime(ts, '%Y'), CAST(CAST(ceil(dayofyear(CAST(ts AS DATE) + CAST(6 - dayofweek(ts) AS INTEGER)) / 7.0) AS INTEGER) AS VARCHAR)) AS week,
    string_split(text, ',') AS tags
  FROM b)
"""


def base(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The base columns of all events. `events` may be a stream of that table. The star's dimensions are left to
    Catalyst, which broadcasts them as long as their size allows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    customer, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    who = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    lat = F.expr("(event_id * 7919 + user_id * 104729) % 180000 - 90000").cast("double") / 1000
    lon = F.expr("(event_id * 15485863 + user_id * 32452843) % 360000 - 180000").cast("double") / 1000
    digit = (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10).cast("string")
    return e.join(who, F.col("user_id") == F.col("c_custkey")).select(
        F.col("event_id").alias("id"), lat.alias("lat"), lon.alias("lon"), F.concat("event_type", F.lit(",K"), digit, F.lit(","), "c_mktsegment").alias("text"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("r_name").alias("country"), F.col("n_name").alias("city"), F.col("event_type").alias("topic"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(base(spark, sf_dir))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
