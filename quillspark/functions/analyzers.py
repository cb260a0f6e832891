"""Analyzers: text columns to term arrays, as Spark expressions, and the same for query strings on the driver.

English: a term is a maximal run of ASCII letters and digits, cut to its first 64 bytes and lower-cased; every other byte separates. Runs are
extracted before lower-casing, as lower() can turn other characters (the Kelvin sign) into ASCII letters. Null and empty texts have no terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERM_BYTES = 64


def english(text: Column) -> Column:
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.transform(runs, lambda t: F.lower(F.substring(t, 1, MAX_TERM_BYTES)))


def keyword(text: Column) -> Column:
    """The whole value as one term; an empty or null value has none."""
    return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def keyword_lower(text: Column) -> Column:
    return keyword(F.lower(text))


def whitespace(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def normalize_bytes(text: Column) -> Column:
    """Each character as the English analyzer sees it: an ASCII letter in lower case, a digit, or a separator (space)."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", " "))


def analyze(text: str | None) -> list[str]:
    """English terms of a query string."""
    return [t[:MAX_TERM_BYTES].lower() for t in re.findall("[A-Za-z0-9]+", text or "")]


ANALYZERS: dict[str, Callable[[Column], Column]] = {"english": english, "keyword": keyword, "keyword_lower": keyword_lower, "whitespace": whitespace}
