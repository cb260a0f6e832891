"""Term patterns: wildcards (over bytes) and regular expressions (Java's dialect), always over the whole term."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def wildcard_regex(pattern: str) -> str:
    """* is any bytes, ? one byte, everything else itself. The regex is for terms decoded as ISO-8859-1, so that a character is a byte."""
    raw = pattern.encode().decode("latin-1")
    out = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() and c.isascii() else f"\\x{ord(c):02x}" for c in raw)
    return rf"(?s)\A{out}\z"


def wildcard_prefix(pattern: str) -> str:
    """What every match begins with."""
    return re.split(r"[*?]", pattern, maxsplit=1)[0]


def wildcard_match(term: Column, pattern: str) -> Column:
    """The literal prefix is a condition of its own, which Spark pushes to a scan. An empty pattern matches only the empty term."""
    whole = F.decode(F.encode(term, "UTF-8"), "ISO-8859-1").rlike(wildcard_regex(pattern))
    return (term.startswith(prefix) & whole) if (prefix := wildcard_prefix(pattern)) else whole


def regexp_match(term: Column, pattern: str) -> Column:
    """Compiled on the driver first: an invalid pattern is a ValueError before any task runs. No literal prefix is pushed: with |, ? or * it would lose terms."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"invalid regular expression: {pattern}") from e
    return term.rlike(rf"\A(?:{pattern})\z")
