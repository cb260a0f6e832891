"""Tables and small files in the folder that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of our own if all runs on one machine (tests), else a ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = work_root(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df range-sorted by keys and written, with `part`: parts follow each other in the order, and each is of a task's size however often a key repeats (if keys are unique together)."""
    return written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "ordered")


class Manifest:
    """Numbered states of a folder. A state is published by renaming a finished file to the next number, which fails if another writer has taken it; readers see the last one.

    Atomic where renames are and refuse names that exist (HDFS, local folders). Object stores promise neither: there let one writer at a time publish.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifests/{name}" if name else f"{self.root}/_manifests")

    def last(self) -> tuple[int, list]:
        """(number, entries) of the last state; (0, []) before the first."""
        if not self._fs.exists(self._path("")):
            return 0, []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        number = max((int(n[:-5]) for n in names if n[0].isdigit() and n.endswith(".json")), default=0)
        if not number:
            return 0, []
        stream = self._fs.open(self._path(f"{number:09d}.json"))
        try:
            return number, json.loads(bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, after: int, entries: list) -> None:
        aside, final = self._path(f".{uuid.uuid4().hex}"), self._path(f"{after + 1:09d}.json")
        stream = self._fs.create(aside)
        try:
            stream.write(bytearray(json.dumps(entries).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError("another writer has published meanwhile")
