"""Sources of documents: a Parquet text column, text lines, and a synthetic Zipf corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_column(spark: SparkSession, path: str, column: str, max_docs: int = 0) -> DataFrame:
    """(text) of one string column; 0 documents: all. A missing column is a KeyError, another type a TypeError, null an empty text."""
    df = spark.read.parquet(path)
    if column not in df.columns:
        raise KeyError(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise TypeError(f"{column} is no string column")
    out = df.select(F.coalesce(F.col(column), F.lit("")).alias("text"))
    return out.limit(max_docs) if max_docs else out


#: Splits whose places are broadcast at most (some 200 bytes each).
BROADCAST_SPLITS = 100_000


def text_lines(spark: SparkSession, path: str, max_docs: int = 0) -> DataFrame:
    """(doc_id, text): each line a document, numbered from 0 by file name and place in it; an empty line is an empty document, a last line needs no newline. max_docs: only the first so many; 0: all.

    Rows aren't moved: lines of a split are numbered as they are read, and what comes before a split is a sum over the counts of splits.
    """
    at = ("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("text"), *(F.col(c).alias(n) for c, n in zip(at, ("file", "start"), strict=True)), F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row for each split
    before, shifts = 0, []
    for r in sorted(splits, key=lambda r: (r["file"], r["start"])):
        shifts.append((r["file"], r["start"], before - r["first"]))
        before += r["n"]
    places = spark.createDataFrame(shifts, "file string, start long, shift long")
    out = lines.join(F.broadcast(places) if len(shifts) <= BROADCAST_SPLITS else places, ["file", "start"]).select((F.col("row") + F.col("shift")).alias("doc_id"), "text")
    return out.where(F.col("doc_id") < max_docs) if max_docs else out


def zipf(spark: SparkSession, docs: int, vocabulary: int, exponent: float = 1.1, mean_length: int = 12, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """(doc_id, tokens): lengths uniform from mean/2 to 3/2 mean, ranks Zipf distributed, and the commonest term first in some 70 % of documents.

    Every value is a hash (12 hexadecimal digits of the MD5 of "seed-doc_id-position"), so it is the same however rows are partitioned, and in any engine. The rank is drawn by inverting the
    continuous distribution, without a table that grows with the vocabulary.
    """
    unit = lambda *c: (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), *c)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    s = 1.0 - exponent if abs(exponent - 1.0) > 1e-9 else 1e-9
    top = float(vocabulary + 1) ** s
    rank = lambda u: F.least(F.lit(vocabulary - 1), (F.pow(F.lit(1.0) + u * F.lit(top - 1.0), F.lit(1.0 / s)) - 1).cast("int"))
    df = spark.range(0, docs, 1, partitions) if partitions else spark.range(docs)
    length = (F.lit(mean_length // 2) + F.floor(unit("id", F.lit(-1)) * F.lit(max(1, mean_length)))).cast("int")
    word = lambda i: F.format_string("w%07d", rank(unit("id", i)))
    tokens = F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), word)
    first = F.when(unit("id", F.lit(-2)) < 0.7, F.array(F.lit("w0000000"))).otherwise(F.array().cast("array<string>"))
    return df.select(F.col("id").alias("doc_id"), F.concat(first, tokens).alias("tokens"))
