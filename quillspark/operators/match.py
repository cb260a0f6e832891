"""Match operators over a text column (scan plans) and over postings (index plans). Each returns the matching doc_ids, once each.

Scan plans need no shuffle: English terms are matched by a regular expression over the raw text, patterns by a test of each term. Index plans
read only the terms they need from postings(term, doc_id, tf, positions), which a sorted table prunes. Empty term lists match nothing.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import analyzers as A
from quillspark.functions import patterns as P


def _ids(docs: DataFrame, condition: Column) -> DataFrame:
    return docs.where(condition).select("doc_id")


def _none(docs: DataFrame) -> DataFrame:
    return docs.where(F.lit(False)).select("doc_id")


def union_ids(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists).distinct()


_RUN = "[A-Za-z0-9]"


def _pattern(terms: list[str], last_is_prefix: bool = False) -> str | None:
    """A regex that finds successive terms in a raw text; None if one of them can't be a term.

    Java's (?i) folds ASCII letters only, as the analyzer does. A term of 64 bytes stands for any longer run that begins with it.
    """
    if not terms or any(not re.fullmatch(f"[a-z0-9]{{1,{A.MAX_TERM_BYTES}}}", t) for t in terms):
        return None
    runs = [t + f"{_RUN}*+" if len(t) == A.MAX_TERM_BYTES else t for t in terms]
    return f"(?i)(?<!{_RUN})" + "[^A-Za-z0-9]++".join(runs) + ("" if last_is_prefix else f"(?!{_RUN})")


class TextScan:
    """docs (doc_id unique, and a text column). Query terms are English terms; other strings match nothing.

    Terms and phrases are found in the raw text by one regular expression, so a scan makes no copy, no array and no shuffle.
    """

    def __init__(self, docs: DataFrame, column: str = "text"):
        self.docs = docs.select("doc_id", F.coalesce(F.col(column), F.lit("")).alias("text"))
        self.tokens = A.english(F.col("text"))

    def _find(self, *patterns: str | None, together=and_) -> DataFrame:
        known = [F.col("text").rlike(p) for p in patterns if p]
        if not known or (together is and_ and len(known) < len(patterns)):
            return _none(self.docs)
        return _ids(self.docs, reduce(together, known))

    def term(self, t: str) -> DataFrame:
        return self._find(_pattern([t]))

    def any_of(self, terms: list[str]) -> DataFrame:
        return self._find(*(_pattern([t]) for t in dict.fromkeys(terms)), together=or_)

    def all_of(self, terms: list[str]) -> DataFrame:
        return self._find(*(_pattern([t]) for t in dict.fromkeys(terms)))

    def everything(self) -> DataFrame:
        return self.docs.select("doc_id")

    def prefix(self, p: str) -> DataFrame:
        """'' matches every document with a term."""
        return self._find(_pattern([p], True) if p else _RUN)

    def wildcard(self, pattern: str) -> DataFrame:
        return _ids(self.docs, F.exists(self.tokens, lambda t: P.wildcard_match(t, pattern)))

    def regexp(self, pattern: str) -> DataFrame:
        return _ids(self.docs, F.exists(self.tokens, lambda t: P.regexp_match(t, pattern)))

    def phrase(self, terms: list[str]) -> DataFrame:
        return self._find(_pattern(terms))

    def phrase_prefix(self, terms: list[str]) -> DataFrame:
        if len(terms) < 2:
            return self.prefix(terms[0]) if terms else _none(self.docs)
        return self._find(_pattern(terms, True))


class KeywordScan:
    """docs (doc_id unique) and a column whose whole values are terms; null and empty values have none. Each query is a filter, which reaches the scan."""

    def __init__(self, docs: DataFrame, column: str):
        self.docs, self.value = docs, F.col(column)

    def _where(self, condition: Column) -> DataFrame:
        return _ids(self.docs, condition & (self.value != ""))

    def term(self, t: str) -> DataFrame:
        return self._where(self.value == t)

    def any_of(self, terms: list[str]) -> DataFrame:
        return self._where(self.value.isin(sorted(set(terms)))) if terms else _none(self.docs)

    def prefix(self, p: str) -> DataFrame:
        return self._where(self.value.startswith(p))

    def wildcard(self, pattern: str) -> DataFrame:
        return self._where(P.wildcard_match(self.value, pattern))

    def regexp(self, pattern: str) -> DataFrame:
        return self._where(P.regexp_match(self.value, pattern))


#: Offsets in a bit column.
_BITS = 62


class PostingsMatch:
    """The same over postings. With positions=False (documents-only index) phrases of two terms and more raise NotImplementedError.

    where: a function from a condition on term to the postings that meet it; a filter on postings if there is none.
    """

    def __init__(self, postings: DataFrame, positions: bool = True, where=None):
        self.postings, self.positions = postings, positions
        self.stored, self.rows = where is None, where or postings.where

    def _where(self, condition: Column) -> DataFrame:
        return self.rows(condition).select("doc_id")

    def term(self, t: str) -> DataFrame:
        return self._where(F.col("term") == t)  # (term, doc_id) is unique

    def any_of(self, terms: list[str]) -> DataFrame:
        return self._where(F.col("term").isin(sorted(set(terms)))).distinct() if terms else _none(self.postings)

    def all_of(self, terms: list[str]) -> DataFrame:
        wanted = sorted(set(terms))
        if len(wanted) < 2:
            return self.term(wanted[0]) if wanted else _none(self.postings)
        found = self.rows(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        return found.where(F.col("n") == len(wanted)).select("doc_id")

    def all_of_rare_first(self, terms: list[str], dictionary: DataFrame) -> DataFrame:
        """For terms of very different frequency: semi-joins from the rarest term on."""
        wanted = sorted(set(terms))
        df = {r["term"]: r["df"] for r in dictionary.where(F.col("term").isin(wanted)).select("term", "df").collect()} if wanted else {}
        if not wanted or len(df) < len(wanted):
            return _none(self.postings)
        out, *rest = [self.term(t) for t in sorted(wanted, key=lambda t: (df[t], t))]
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), rest, out)

    def prefix(self, p: str) -> DataFrame:
        return self._where(F.col("term").startswith(p) if p else F.lit(True)).distinct()

    def wildcard(self, pattern: str) -> DataFrame:
        return self._where(P.wildcard_match(F.col("term"), pattern)).distinct()

    def regexp(self, pattern: str) -> DataFrame:
        return self._where(P.regexp_match(F.col("term"), pattern)).distinct()

    def terms_like(self, predicate) -> DataFrame:
        """Documents of all terms for which predicate (a Column of a Column) holds."""
        return self._where(predicate(F.col("term"))).distinct()

    def _starts(self, conditions: list[Column]) -> DataFrame:
        """Documents in which a term of condition k stands at p + k for some p and all k."""
        if not self.positions:
            raise NotImplementedError("the index has no positions")
        offsets = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(conditions))))
        rows = self.rows(reduce(or_, conditions)).select("doc_id", F.explode("positions").alias("pos"), offsets.alias("offs"))
        starts = rows.select("doc_id", "pos", F.explode("offs").alias("off")).select("doc_id", (F.col("pos") - F.col("off")).alias("start"), "off")
        # a bit for each offset that is met, _BITS to a column
        sets = range(-(-len(conditions) // _BITS))
        bits = starts.groupBy("doc_id", "start").agg(*(F.bit_or(F.when(F.floor(F.col("off") / _BITS) == k, F.expr(f"shiftleft(1L, off % {_BITS})"))).alias(f"bits{k}") for k in sets))
        full = reduce(and_, (F.col(f"bits{k}") == (1 << min(_BITS, len(conditions) - k * _BITS)) - 1 for k in sets))
        return bits.where(full).select("doc_id").distinct()

    def phrase(self, terms: list[str]) -> DataFrame:
        """Of any length, repeats allowed."""
        if not terms:
            return _none(self.postings)
        if not self.positions:
            raise NotImplementedError("the index has no positions")
        return self.term(terms[0]) if len(terms) == 1 else self._starts([F.col("term") == t for t in terms])

    def phrase_prefix(self, terms: list[str]) -> DataFrame:
        if len(terms) < 2:
            return self.prefix(terms[0]) if terms else _none(self.postings)
        return self._starts([*(F.col("term") == t for t in terms[:-1]), F.col("term").startswith(terms[-1])])
