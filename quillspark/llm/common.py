"""What the training-data operators share: the shared work folder, Arrow batches, checked broadcasts."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.arrow import BATCH_BYTES, BATCH_ROWS, give_back, in_arrow  # noqa: F401

#: Code points that separate words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Ids are broadcast only up to this count (8 bytes each, some 50 MB hashed); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: A key is hot if it has more than HOT_ROWS rows and more than one in HOT_KEYS of all, so there are HOT_KEYS hot ones at most.
HOT_ROWS, HOT_KEYS = 1000, 1000


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/quillspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage, and a lost executor takes nothing along."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Frames of an iteration, each written in the shared folder; the one before is deleted, as nothing is computed from it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def __call__(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.parquet(path)
        if self.path:
            old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def worker_cache(name: str, make):
    """An object made once for each Python worker, such as a tokenizer."""
    held = sys.modules[__name__].__dict__.setdefault("_held", {})
    if name not in held:
        held[name] = make()
    return held[name]


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as a long and text (null: empty), and no other column, whatever docs has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def small_enough(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if, counted, they are BROADCAST_IDS at most. ids must be cheap to read again."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (one column of longs, cheap to read again); null doc_ids stay. The ids are broadcast if counted small, else joined. Columns of docs may have any names."""
    key = unused_name(docs, "gone")
    ids = small_enough(gone.toDF(key).distinct())
    return docs.join(ids, docs["doc_id"].cast("long") == ids[key], "left_anti")


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """rows joined to facts, which has a key at most once; rows without facts are left out. Both must be cheap to read again. hot: the keys of more rows than hot_limit(), if known.

    Keys that over HOT_ROWS rows and over one in HOT_KEYS of all rows have, of which there are HOT_KEYS at most, are joined by broadcasting
    their facts, so their rows stay where they are; all others are shuffled by key.
    """
    if hot is None:
        hot = [r[key] for r in rows.groupBy(key).count().where((F.col("count") > hot_limit(rows.count())) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(facts, key)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    spread = rows.join(keys, key, "left_semi").join(F.broadcast(facts.join(keys, key, "left_semi")), key)
    return rows.join(keys, key, "left_anti").join(facts, key).unionByName(spread)


def words(text: Column) -> Column:
    """The words of a text, by Spark functions only."""
    return F.array_remove(F.split(text, SPACE), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
