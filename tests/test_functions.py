"""Analyzers and patterns against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import analyzers as A
from quillspark.functions import patterns as P

TEXTS = ["The Quick-brown FOX", "", "---", "a1b2 C3", '{"k": "v", "n": 12}', "x" * 70 + " y", "é K café naïve", "a  b\n\tc", "z" * 64, None]


def test_english(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("i", A.english(F.col("t")).alias("a")).collect():
        assert r["a"] == A.analyze(TEXTS[r["i"]])
    assert A.analyze("x" * 70) == ["x" * 64]


def test_keyword_and_whitespace(spark):
    df = spark.createDataFrame([("A b",), ("",), (None,)], "t string")
    rows = df.select(A.keyword(F.col("t")).alias("k"), A.keyword_lower(F.col("t")).alias("l"), A.whitespace(F.col("t")).alias("w")).collect()
    assert [r["k"] for r in rows] == [["A b"], [], []]
    assert [r["l"] for r in rows] == [["a b"], [], []]
    assert [r["w"] for r in rows] == [["A", "b"], [], []]


@pytest.mark.parametrize("pattern", ["aa_*", "aa_00?", "*", "?", "", "a[b]*", "a\\*", "caf??", "*é", "a.c"])
def test_wildcards(spark, pattern):
    def brute(term):  # over bytes
        out = b"".join(b".*" if c == ord("*") else b"." if c == ord("?") else re.escape(bytes([c])) for c in pattern.encode())
        return bool(re.fullmatch(out, term.encode(), re.S))

    terms = ["aa_001", "aa_00", "", "a", "a[b]x", "ab", "a\\x", "café", "cafe", "é", "abc", "a.c", "a\nc"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert {r["t"] for r in df.where(P.wildcard_match(F.col("t"), pattern)).collect()} == {t for t in terms if brute(t)}


def test_regexps(spark):
    df = spark.createDataFrame([(t,) for t in ("aa1", "bb", "a", "ab", "abb", "a\n")], "t string")
    run = lambda p: {r["t"] for r in df.where(P.regexp_match(F.col("t"), p)).collect()}
    assert run("aa[0-9]|bb") == {"aa1", "bb"}
    assert run("ab*") == {"a", "ab", "abb"}
    assert run("ab?") == {"a", "ab"}
    with pytest.raises(ValueError):
        run("[")
