"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and a folder of manifests. An append writes what arrives as small shards; a
compaction merges runs of shards of similar size into files of the target size. Either becomes visible by one atomic step: the next
numbered manifest is written aside and renamed to its name, and a rename onto a name that exists fails, so of two writers one wins.
Readers name the files of one manifest; shards that no manifest names (of failed jobs) are never read.

All paths go through Hadoop's file systems. The commit is atomic where a rename is and refuses a name that exists, as in HDFS and local folders. Object stores
promise neither: there a reader may meet a manifest that is half copied, and of two writers at once both may think that they won, so let one writer at a time commit.

Rows are stored as they come: null, empty and repeated ones too, columns of any names.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shard:
    path: str
    n_bytes: int


class ShardStore:
    """target_bytes: size of a full shard. ratio: a tier holds shards of up to so many times the size. fan_in: shards that make a tier due."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, ratio: float = 4.0, fan_in: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.ratio, self.fan_in = target_bytes, ratio, fan_in
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        """Of the newest manifest; 0 if there is none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return max((int(n[1:-5]) for n in names if n[:1] == "v" and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"manifests/v{version:09d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, base: int, schema: str, shards: list[Shard]) -> int:
        """Makes shards the state after version base; RuntimeError if another writer has made one meanwhile."""
        name = f"v{base + 1:09d}.json"
        aside, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{name}")
        stream = self._fs.create(aside)
        try:
            stream.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "shards": [[s.path, s.n_bytes] for s in shards]}).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"{name} has been committed by another writer")
        return base + 1

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(p, n) for p, n in self.manifest(version)["shards"]]

    def _written(self, folder: str) -> list[Shard]:
        files = self._fs.listFiles(self._path(folder), True)
        out = []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                out.append(Shard(f.getPath().toString(), f.getLen()))
        return sorted(out, key=lambda s: s.path)

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Writes rows as small shards, one for each task, and commits. With arrival, a column that isn't stored, a task writes one for each of its values."""
        state = self.manifest()
        folder = f"shards/a-{uuid.uuid4().hex}"
        schema = T.StructType([f for f in rows.schema if f.name != arrival])
        if state["schema"] and json.loads(state["schema"]) != json.loads(schema.json()):
            raise ValueError("an arrival must have the store's schema")
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(arrival) if arrival else writer).parquet(f"{self.root}/{folder}")
        return self.commit(state["version"], schema.json(), [Shard(*s) for s in state["shards"]] + self._written(folder))

    def tiers(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        """Shards below half the target by tier; tier t holds sizes from ratio ** t."""
        out: dict[int, list[Shard]] = {}
        for s in shards:
            if s.n_bytes * 2 < self.target:
                out.setdefault(int(math.log(max(s.n_bytes, 1), self.ratio)), []).append(s)
        return out

    def compact(self, everything: bool = False) -> int:
        """Merges each tier that has fan_in shards (everything: all small shards at once) and commits; the version is the old one if none is due.

        A merge is one job without a shuffle: Spark packs whole small files into partitions of up to the target and each task writes one file.
        """
        state = self.manifest()
        shards = [Shard(*s) for s in state["shards"]]
        tiers = self.tiers(shards)
        due = [[s for t in tiers.values() for s in t]] if everything else [t for t in tiers.values() if len(t) >= self.fan_in]
        due = [t for t in due if len(t) > 1]
        if not due:
            return state["version"]
        gone = {s.path for t in due for s in t}
        kept = [s for s in shards if s.path not in gone]
        for run in due:
            folder = f"shards/c-{uuid.uuid4().hex}"
            self._merge(run, T.StructType.fromJson(json.loads(state["schema"])), folder)
            kept += self._written(folder)
        return self.commit(state["version"], state["schema"], kept)

    def _merge(self, run: list[Shard], schema: T.StructType, folder: str) -> None:
        apart = self.spark.newSession()  # its settings are its own
        for k, v in {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
            apart.conf.set(k, v)
        rows = apart.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[s.path for s in run])
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All rows of a version, with the name of each row's file in a column `shard` if asked for; a name that the rows have is a ValueError. So is an empty store, as it has no schema."""
        state = self.manifest(version)
        if not state["schema"]:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        if shard and shard.lower() in (n.lower() for n in schema.names):
            raise ValueError(f"the rows have a column {shard}")
        if not state["shards"]:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(shard, F.lit(None).cast("string")) if shard else rows
        rows = self.spark.read.schema(schema).parquet(*[p for p, _ in state["shards"]])
        return rows.withColumn(shard, F.col("_metadata.file_name")) if shard else rows

    def vacuum(self, keep: int = 1) -> int:
        """Deletes shards that none of the last `keep` versions names; how many. Not to be called while others write."""
        last = self.version()
        named = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)}
        gone = [s for s in self._written("shards") if s.path not in named]
        for s in gone:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(s.path), False)
        return len(gone)
