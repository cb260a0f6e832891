"""Dictionary and corpus statistics over postings, dictionary, lengths and tokens; everything also over the union of shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.work import in_order


def lookup(dictionary: DataFrame, term: str) -> DataFrame:
    return dictionary.where(F.col("term") == term)


def prefix_terms(dictionary: DataFrame, prefix: str) -> DataFrame:
    """Terms with the prefix in byte order; '' gives all."""
    found = dictionary.where(F.col("term").startswith(prefix)) if prefix else dictionary
    return found.select("term").orderBy("term")


def of_terms(spark: SparkSession, dictionary: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, ttf) of each asked term once; 0 where it is absent."""
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    found = dictionary.where(F.col("term").isin(list(dict.fromkeys(terms)))).select("term", "df", "ttf")
    return asked.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"), F.coalesce("ttf", F.lit(0)).cast("long").alias("ttf"))


def documents(lengths: DataFrame) -> DataFrame:
    """One row: doc_count, sum_total_term_freq, avgdl. Empty documents count."""
    docs = lengths.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("len"), F.lit(0)).alias("sum_total_term_freq"))
    return docs.withColumn("avgdl", F.col("sum_total_term_freq") / F.greatest(F.lit(1), F.col("doc_count")))


def segment(lengths: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: doc_count, indexed_doc_count, term_count, sum_total_term_freq, null_count, avgdl."""
    terms = dictionary.agg(F.count(F.lit(1)).alias("term_count"))
    return documents(lengths).crossJoin(F.broadcast(terms)).select("doc_count", F.col("doc_count").alias("indexed_doc_count"), "term_count", "sum_total_term_freq", F.lit(0).cast("long").alias("null_count"), "avgdl")


def norm_of(lengths: DataFrame, doc_id: int) -> int:
    row = lengths.where(F.col("doc_id") == doc_id).select("norm").first()
    if row is None:
        raise ValueError(f"no document {doc_id}")
    return row["norm"]


def _pickable(dictionary: DataFrame) -> DataFrame:
    """All terms but the last in byte order."""
    return dictionary.crossJoin(F.broadcast(dictionary.agg(F.max("term").alias("last")))).where("term <> last").drop("last")


def in_df_bucket(dictionary: DataFrame, low: int, high: int) -> DataFrame:
    """The least term with low <= df <= high."""
    return _pickable(dictionary).where(F.col("df").between(low, high)).select("term", "df").orderBy("term").limit(1)


def at_df(dictionary: DataFrame, target: int) -> DataFrame:
    """The term whose df is nearest; ties go to the least term."""
    return _pickable(dictionary).select("term", "df").orderBy(F.abs(F.col("df") - target), "term").limit(1)


def highest_df(dictionary: DataFrame) -> DataFrame:
    return _pickable(dictionary).select("term", "df").orderBy(F.col("df").desc(), "term").limit(1)


def lowest_df(dictionary: DataFrame) -> DataFrame:
    return _pickable(dictionary).select("term", "df").orderBy("df", "term").limit(1)


def middle_df(dictionary: DataFrame) -> DataFrame:
    """The term in the middle by (df, term): the least one that has half of the terms at or before it.

    Terms are range-sorted and written; counts by part say which part holds the middle, and only that one, which is of a task's size, is ranked.
    """
    terms = in_order(_pickable(dictionary).select("term", "df"), "df", "term")
    at, parts = 0, sorted((r["part"], r["count"]) for r in terms.groupBy("part").count().collect())  # a row for each part
    middle = sum(n for _, n in parts) // 2
    for part, n in parts:
        if at <= middle < at + n:
            ranked = terms.where(F.col("part") == part).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("df", "term")))
            return ranked.where(F.col("r") == middle - at + 1).select("term", "df")
        at += n
    return terms.select("term", "df")


def absent(dictionary: DataFrame) -> DataFrame:
    """The first zzq{n} that is no term: 0 or a number after one that is there, the least of those that aren't there."""
    there = dictionary.where(F.col("term").startswith("zzq") & F.col("term").rlike(r"\Azzq(0|[1-9][0-9]{0,17})\z")).select(F.substring("term", 4, 18).cast("long").alias("n"))
    zero = dictionary.sparkSession.range(1).select(F.col("id").alias("n"))
    first = there.select((F.col("n") + 1).alias("n")).unionByName(zero).join(there, "n", "left_anti").agg(F.min("n").alias("n"))
    return first.select(F.concat(F.lit("zzq"), F.col("n").cast("string")).alias("term"))


def cooccurring(postings: DataFrame, dictionary: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """(a, b, doc_id): a is the least term of the first df band; b the earliest other term of the second band in a's first document that has one."""
    a = in_df_bucket(dictionary, *first).select(F.col("term").alias("a"))
    docs = postings.join(F.broadcast(a), F.col("term") == F.col("a"), "inner").select("doc_id", "a")
    band = _pickable(dictionary).where(F.col("df").between(*second)).select("term")
    others = postings.join(band, "term", "left_semi").join(docs, "doc_id").where("term <> a")
    return others.select("a", F.col("term").alias("b"), "doc_id", F.element_at("positions", 1).alias("pos")).orderBy("doc_id", "pos").limit(1).select("a", "b", "doc_id")


def first_phrase(tokens: DataFrame, n: int, excluded: str | None = None) -> DataFrame:
    """(doc_id, pos, phrase) of the first n successive terms free of the excluded one. tokens (doc_id, pos, term)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    ahead = [F.lead("term", k).over(order) if k else F.col("term") for k in range(n)]
    rows = tokens.select("doc_id", "pos", F.array(*ahead).alias("w")).where(F.forall("w", lambda t: t.isNotNull()))
    if excluded is not None:
        rows = rows.where(~F.array_contains("w", excluded))
    return rows.orderBy("doc_id", "pos").limit(1).select("doc_id", "pos", F.array_join("w", " ").alias("phrase"))
