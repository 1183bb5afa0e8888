"""The object table as a stream's sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geostrata.functions.spatial import Grid
from geostrata.operators.retention import HOURS
from geostrata.schema import BASE
from geostrata.storage import Folder

#: Objects within a file lie together by the cells of this grid, so a rectangle reads few row groups.
CLUSTER = Grid(64, 64)


def write_objects(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "1 minute", keep_hours: int | None = None) -> StreamingQuery:
    """Base columns of objects in a Parquet table with a folder for each micro-batch and hour: exactly once, as a batch that
    runs again replaces its own folder. With `keep_hours`, hours but the latest so many are removed after each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        clustered(batch.withColumn("hour", F.date_format("ts", "yyyyMMddHH"))).write.mode("overwrite").partitionBy("hour").parquet(f"{path}/batch={batch_id}")
        if keep_hours:
            retain(batch.sparkSession, path, keep_hours)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Base columns of the objects of a table that `write_objects` writes, of batches that are written as a whole."""
    done = [x.split("/")[0] for x in Folder(spark, path).names("batch=*/_SUCCESS")]
    columns = [F.col(x.name) for x in BASE]
    if not done:
        return spark.createDataFrame([], BASE)
    return spark.read.option("basePath", path).schema(BASE).parquet(*(f"{path}/{x}" for x in done)).select(*columns)


def retain(spark: SparkSession, path: str, hours: int = HOURS) -> list[str]:
    """Removes the folders of all hours but the latest ones that the table has; which are left is returned. A late object
    of an hour that was removed goes with the next call, unless its hour is among the latest again."""
    folder = Folder(spark, path)
    found = folder.names("batch=*/hour=*")
    hour_of = lambda x: x.rsplit("=", 1)[1]
    kept = sorted({hour_of(x) for x in found})[-hours:]
    for x in found:
        if hour_of(x) not in kept:
            folder.remove(x)
    return kept


def clustered(objects: DataFrame) -> DataFrame:
    """Objects of an hour in the order of their cell, so that a rectangle reads few row groups. A busy hour is divided by
    cells, by ranges that are sampled from the data."""
    cell = CLUSTER.cell(F.col("lat"), F.col("lon"))
    return objects.repartitionByRange("hour", cell).sortWithinPartitions("hour", cell)
