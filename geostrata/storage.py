"""Where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: what the session names in spark.checkpoint.dir. Only on a local master, as in
    tests, a folder of this machine serves where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "geostrata")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most so many rows; reads no more of it than that takes."""
    return df.limit(rows + 1).count() <= rows


class Folder:
    """Files and folders below a path, wherever Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark.sparkContext._jvm, path
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, pattern: str) -> list[str]:
        """Paths below the folder, relative to it, that match."""
        root = self._fs.makeQualified(self._at("")).toString().rstrip("/")
        return sorted(x.getPath().toString()[len(root) + 1 :] for x in self._fs.globStatus(self._at(pattern)) or [])

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all: written beside its place, then moved."""
        beside = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(beside, self._at(name)):
            raise OSError(f"{name} can't be written")
