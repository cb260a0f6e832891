"""Line-first cleaning with Spark functions only.

Each line is judged by itself: share of symbols, separators of navigation, shouting, missing sentence punctuation, boilerplate
phrases. Failing lines are removed, and a document that loses more than a given share of its word characters is rejected, as is one
that fails the base rules (too few words, too much text in repeated 8-word windows). A null or empty text has no words and is rejected.
All expressions are row-local: no shuffle, no Python, and memory bounded by the text itself.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import words

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Rules of a line: percent of its characters that may be symbols or exclamation marks, separators that make navigation (and a line's characters for each), and phrases.
MAX_SYMBOL_PERCENT, MAX_SHOUT_PERCENT, SEPARATORS, SEPARATOR_CHARS = 6, 6, 2, 24
#: Boilerplate by language, as regular expressions over lower-cased lines; the default of judged()'s parameter.
PHRASES = {
    "en": ("cookie policy", "privacy policy", "terms of (use|service)", "all rights reserved", "subscribe to our", "sign up for our", "click here to", "enable javascript", "skip to (main )?content", "lorem ipsum"),
    "fr": ("politique de confidentialité", "mentions légales", "conditions d.utilisation", "tous droits réservés", "abonnez-vous", "cliquez ici"),
    "de": ("datenschutzerklärung", "impressum", "nutzungsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "klicken sie hier"),
    "es": ("política de privacidad", "aviso legal", "condiciones de uso", "todos los derechos reservados", "suscríbete", "haga clic aquí"),
}
BOILERPLATE = "|".join(x for phrases in PHRASES.values() for x in phrases)
#: The end of a sentence within a line or at its end: Latin marks before white space, or marks of other scripts (Chinese, Japanese, Hindi, Arabic, Urdu, Amharic), which need none. Thai has no such mark.
SENTENCE = r"""[.!?…:;]["')\]»”]*([\x20\x09-\x0D]|\z)|[。！？｡।॥؟۔።፧]"""
#: A document is rejected if it loses more than this share of its word characters.
MAX_LOST_PERCENT = 50


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def _literal(phrase: str) -> str:
    """The longest run of plain characters that a phrase's every match has."""
    return max(re.sub(r"\([^)]*\)\??|.\?|\.", "\n", phrase).split("\n"), key=len)


def _has_phrase(text: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """Whether a text holds the plain part of some phrase: what is cheap to ask of a whole text."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in sorted({_literal(p) for v in phrases.values() for p in v})), F.lit(False))


def line_ends_well(line: Column) -> Column:
    """The punctuation rule: a sentence ends in the line."""
    return line.endswith(".") | line.rlike(SENTENCE)


def line_passes(line: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """Whether one line (with a word) passes all rules."""
    pattern = "|".join(p for v in phrases.values() for p in v)
    n, parts = F.length(line), F.size(F.split(line, r" [|>·•] ")) - 1
    return (
        line_ends_well(line)
        & (_symbols(line) * 100 <= n * MAX_SYMBOL_PERCENT)
        & (F.regexp_count(line, F.lit("!")) * 100 <= n * MAX_SHOUT_PERCENT)
        & ((parts < SEPARATORS) | (parts * SEPARATOR_CHARS < n))
        & (~F.lower(line).rlike(pattern) if pattern else F.lit(True))
    )


def repeated_words(docs: DataFrame, tokens: str, out: str, own: str) -> DataFrame:
    """docs with column `out`: words in windows of WINDOW words that are found twice or more in the text, the first included.

    Equal windows agree in five of their words, so texts in which no hash of those five repeats have none; the others are looked at
    again, by all words of each window, so the count is exact. Stages are columns of their own (`own` begins their names) so that no lambda evaluates another stage anew.
    """
    c = {k: own + k for k in ("n", "h", "again", "w", "v", "p", "q")}
    word = lambda i, k: F.col(tokens)[i + k]
    n = F.greatest(F.size(tokens) - (WINDOW - 1), F.lit(0))
    places = F.sequence(F.lit(0), F.col(c["n"]) - 1)
    hashes = F.transform(places, lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 3), word(i, 5), word(i, WINDOW - 1)))
    d = docs.withColumn(c["n"], n).withColumn(c["h"], F.when(F.col(c["n"]) > 1, hashes).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn(c["again"], F.size(F.array_distinct(c["h"])) < F.size(c["h"]))
    # (window, place) sorted: equal windows are neighbours
    windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *(word(i, k) for k in range(WINDOW))).alias("w"), i.alias("i")))
    d = d.withColumn(c["w"], F.when(F.col(c["again"]), F.sort_array(windows)).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    d = d.withColumn(c["v"], F.slice(c["w"], F.lit(2), F.greatest(F.size(c["w"]) - 1, F.lit(0))))
    pairs = F.zip_with(F.slice(c["w"], F.lit(1), F.size(c["v"])), c["v"], lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn(c["p"], F.array_distinct(F.sort_array(F.flatten(pairs))))
    d = d.withColumn(c["q"], F.slice(c["p"], F.lit(2), F.greatest(F.size(c["p"]) - 1, F.lit(0))))
    steps = F.zip_with(F.slice(c["p"], F.lit(1), F.size(c["q"])), c["q"], lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x) + F.when(F.size(c["p"]) > 0, WINDOW).otherwise(0)
    return d.withColumn(out, F.when(F.col(c["again"]), covered).otherwise(0).cast("long")).drop(*c.values())


JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_percent", "kept")


def judged(docs: DataFrame, phrases: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """docs and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, clean_text, lost_percent, kept.

    Columns of docs that have one of these names are replaced, all others stay; repeated rows are judged alike. clean_text is the text without its failing lines (null for null).
    phrases: boilerplate by language, regular expressions in lower case whose only marks are groups, ? and the dot.
    """
    own = "q_"
    while any(x.lower().startswith(own) for x in docs.columns):
        own += "_"
    text, tokens, lines, all_rules, good, lost = (own + x for x in ("text", "tokens", "lines", "all_rules", "good", "lost"))
    chars = lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", ""))
    rest = [x for x in docs.columns if x.lower() not in JUDGED]
    d = docs.select(*rest, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text)).withColumn(tokens, words(F.col(text)))
    d = d.withColumn(lines, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = repeated_words(d, tokens, "n_repeat_words", own)
    d = (
        d.withColumn("n_words", F.size(tokens).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(tokens, "")).cast("long"))
        .withColumn("n_symbols", _symbols(F.col(text)).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
        # most texts hold nothing that the costlier rules look for in any line; no lambda refers to a column, which Spark would compute anew for each line
        .withColumn(all_rules, (F.col("n_symbols") > 0) | F.contains(text, F.lit("!")) | F.col(text).rlike(" [>·•] ") | _has_phrase(F.lower(text), phrases))
        .withColumn(good, F.when(F.col(all_rules), F.filter(lines, lambda x: line_passes(x, phrases))).otherwise(F.filter(lines, line_ends_well)))
        .withColumn(lost, F.when(F.size(good) == F.size(lines), 0).otherwise(F.col("word_chars") - chars(F.array_join(good, "\n"))))
        .withColumn("kept", ~F.col("base_failed") & (F.col(lost) * 100 <= F.col("word_chars") * MAX_LOST_PERCENT))
        .withColumn("clean_text", F.when(F.col("text").isNotNull(), F.array_join(good, "\n")))
        .withColumn("lost_percent", F.col(lost) * 100.0 / F.greatest(F.col("word_chars"), F.lit(1)))
    )
    # Results pass through a generator of one row. Spark pushes filters on columns of docs below it, and keeps filters on results above it: else these would be
    # written out in terms of the text, which would be split anew for every word.
    return d.select(*rest, F.inline(F.array(F.struct(*JUDGED))))


def clean(docs: DataFrame, phrases: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """The kept rows of docs with failing lines removed and n_chars (if there) brought up to date; the columns are those of docs, whatever their names, also for null doc_ids and repeated rows."""
    d = judged(docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)), "text"), phrases).where("kept")
    out = []
    for i, c in enumerate(docs.columns):
        new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema[c].dataType)}.get(c, F.col(f"in_{i}"))
        out.append(new.alias(c))
    return d.select(*out)
