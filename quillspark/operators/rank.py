"""BM25 top-K over texts (one scan) or an index, exhaustive or with block-max pruning. Order: score down, doc_id up.

Scores are summed in query order (a repeated term counts as often) and rounded to 9 digits before ordering, so that every plan and partitioning gives
the same result. Absent terms add nothing; documents without any query term aren't returned; k = 0 gives none.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import analyzers as A
from quillspark.functions.scoring import Bm25, encode_norm, idf, max_score, term_score

DIGITS = 9


def _top(scored: DataFrame, k: int) -> DataFrame:
    out = scored.select("doc_id", F.round("score", DIGITS).alias("score"))
    return out.orderBy(F.col("score").desc(), "doc_id").limit(k)


def top_k_texts(docs: DataFrame, terms: list[str], k: int = 10, params: Bm25 = Bm25(), column: str = "text", min_score: float | None = None) -> DataFrame:
    """docs (doc_id, text). Two passes over the text: one row of statistics, then scores; neither shuffles documents."""
    if not terms or k <= 0:
        return docs.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    unique = list(dict.fromkeys(terms))
    tokens = docs.select("doc_id", A.english(F.col(column)).alias("t"))
    counts = tokens.select("doc_id", F.size("t").alias("len"), *[(F.size("t") - F.size(F.array_remove("t", t))).alias(f"tf{i}") for i, t in enumerate(unique)])
    stats = counts.agg(F.count(F.lit(1)).alias("N"), (F.sum("len") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(unique))])
    hit = counts.where(reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(unique))))).crossJoin(F.broadcast(stats))  # one row
    norm = encode_norm(F.col("len"))
    parts = [F.when(F.col(f"tf{i}") > 0, term_score(F.col(f"tf{i}"), norm, idf(F.col("N"), F.col(f"df{i}")), F.col("avgdl"), params)).otherwise(0.0) for i in (unique.index(t) for t in terms)]
    scored = hit.select("doc_id", reduce(add, parts).alias("score"))
    return _top(scored.where(F.col("score") >= min_score) if min_score is not None else scored, k)


def _known(index, terms: list[str]) -> DataFrame:
    """(term, df) of the query's terms, a row for each at most. An index that stores nothing counts the asked postings."""
    asked = F.col("term").isin(list(dict.fromkeys(terms)))
    return F.broadcast(index.dictionary.where(asked).select("term", "df") if index.stored else index.rows(asked).groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def _scores(postings: DataFrame, known: DataFrame, stats: DataFrame, terms: list[str], params: Bm25) -> DataFrame:
    """(doc_id, score) of every document with a query term. postings: of the query's terms."""
    unique = list(dict.fromkeys(terms))
    hit = postings.select("term", "doc_id", "tf", "norm").join(known, "term").crossJoin(F.broadcast(stats))  # one row
    hit = hit.select("doc_id", "term", term_score(F.col("tf"), F.col("norm"), idf(F.col("doc_count"), F.col("df")), F.col("avgdl"), params).alias("s"))
    sums = hit.groupBy("doc_id").agg(*[F.sum(F.when(F.col("term") == t, F.col("s"))).alias(f"s{i}") for i, t in enumerate(unique)])
    return sums.select("doc_id", reduce(add, (F.coalesce(F.col(f"s{unique.index(t)}"), F.lit(0.0)) for t in terms)).alias("score"))


def top_k(index, terms: list[str], k: int = 10, params: Bm25 = Bm25(), min_score: float | None = None) -> DataFrame:
    """index: an Index with norms (else ValueError)."""
    index.need_norms()
    if not terms or k <= 0:
        return index.postings.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    scored = _scores(index.rows(F.col("term").isin(list(dict.fromkeys(terms)))), _known(index, terms), index.doc_stats, terms, params)
    return _top(scored.where(F.col("score") >= min_score) if min_score is not None else scored, k)


def top_k_block_max(index, terms: list[str], k: int = 10, params: Bm25 = Bm25(), seed_blocks: int = 4) -> DataFrame:
    """The result of top_k with fewer documents scored: block bounds prune what can't be among the first k.

    1. Documents in the best few blocks of each term are scored in full; the k-th best is a lower bound of the k-th score. 2. A document's upper bound is the sum of
    its blocks' bounds over the terms, blocks being ranges of doc_id, so bounds add up by block number; ranges that fall below the lower bound are dropped (ties stay).
    3. What survives is scored. Only query terms' blocks are read for the bounds, and the lower bound is one number on the driver.
    """
    index.need_norms()
    if not terms or k <= 0:
        return index.postings.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    unique = list(dict.fromkeys(terms))
    weight: Column = reduce(lambda a, t: F.when(F.col("term") == t, F.lit(float(terms.count(t)))).otherwise(a), unique, F.lit(0.0))
    known, asked = _known(index, terms), F.col("term").isin(unique)
    bounds = index.blocks.where(asked).join(known, "term").crossJoin(F.broadcast(index.doc_stats))
    bounds = bounds.select("term", "block", (weight * max_score(F.col("max_tf"), F.col("min_norm"), idf(F.col("doc_count"), F.col("df")), F.col("avgdl"), params)).alias("bound"))
    total = bounds.groupBy("block").agg(F.sum("bound").alias("bound"))
    best = [r["block"] for r in total.orderBy(F.col("bound").desc(), "block").limit(max(1, seed_blocks) * len(unique)).collect()]
    rows = index.rows(asked).withColumn("block", F.floor(F.col("doc_id") / index.block_docs))
    sample = _top(_scores(rows.where(F.col("block").isin(best)), known, index.doc_stats, terms, params), k).collect()
    floor_ = sample[-1]["score"] - 1e-8 if len(sample) == k else 0.0
    left = rows.join(total.where(F.col("bound") >= floor_).select("block"), "block", "left_semi")
    return _top(_scores(left, known, index.doc_stats, terms, params), k)
