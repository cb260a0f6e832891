"""BM25 arithmetic as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def encode_norm(length: Column) -> Column:
    """A document's length in one byte: from 1 to 255."""
    return F.greatest(F.lit(1), F.least(F.lit(255), length)).cast("int")


def decode_norm(norm: Column) -> Column:
    return F.when(norm == 0, F.lit(1.0)).otherwise(norm.cast("double"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_score(tf: Column, norm: Column, idf_: Column, avgdl: Column, params: Bm25 = Bm25()) -> Column:
    """avgdl is of unclamped lengths, the norm is clamped. 0 where tf is 0."""
    k1, b = params.k1, params.b
    length = decode_norm(norm) / F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    return idf_ * (tf * F.lit(k1 + 1.0)) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length))


def max_score(max_tf: Column, min_norm: Column, idf_: Column, avgdl: Column, params: Bm25 = Bm25()) -> Column:
    """No document with at most max_tf and at least min_norm scores more: the score rises with tf and falls with length."""
    return term_score(max_tf, min_norm, idf_, avgdl, params)
