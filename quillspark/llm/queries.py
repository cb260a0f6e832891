"""The training-data operators applied to their whole tables with production parameters, as queries, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, chunk_dedup, html_extract, media, ngram_join, packing, quality_rules, site_bayes, viterbi
from quillspark.llm.common import new_path, table
from quillspark.llm.compaction import ShardStore

#: op2's contract: three words, similarity of 90 percent.
JOIN_WORDS, JOIN_PERCENT = 3, 90
#: op3's arrivals.
ARRIVALS = 4


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), JOIN_WORDS, JOIN_PERCENT)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in ARRIVALS appends, each of small shards; after each the store is compacted if due, and is read back through the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "store"))
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file is a BPE model, whose scores are ranks; as a unigram vocabulary its pieces are scored by Zipf's law."""
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), viterbi.ZIPF)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_ngram_jaccard_join, op3_sharding, op4_quality_rules, op5_substring_dedup, op6_byte_bpe, op7_best_fit_packing, op8_quality_classifier, op9_media_columns, op10_token_counts)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL = {
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
""",
    "op3_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op4_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM t WHERE len(words) >= 8),
txt AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM win),
rep AS (SELECT doc_id, i FROM txt QUALIFY count(*) OVER (PARTITION BY doc_id, w) >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS g(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(lines) AS l FROM t),
lw AS (SELECT doc_id, l, length(l) AS n, length(l) - length(translate(l, '{quality_rules.SYMBOLS}', '')) AS sym, length(l) - length(translate(l, '!', '')) AS shouts,
    len(regexp_split_to_array(l, ' [|>·•] ')) - 1 AS seps FROM ln),
good AS (SELECT doc_id, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM lw
  WHERE sym * 100 <= n * {quality_rules.MAX_SYMBOL_PERCENT} AND shouts * 100 <= n * {quality_rules.MAX_SHOUT_PERCENT} AND (seps < {quality_rules.SEPARATORS} OR seps * {quality_rules.SEPARATOR_CHARS} < n)
    AND regexp_matches(l, '{quality_rules.SENTENCE.replace("'", "''")}')
    AND NOT regexp_matches(lower(l), '{quality_rules.BOILERPLATE}') GROUP BY doc_id),
f AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(translate(x, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(good.chars, 0) AS good FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN good USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (word_chars - good) * 100 <= word_chars * {quality_rules.MAX_LOST_PERCENT} AS kept FROM f
""",
}
