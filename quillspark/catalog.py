"""One query for each operator, over whole tables, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import analyzers as A
from quillspark.functions.scoring import Bm25
from quillspark.operators import match, rank, statistics
from quillspark.plans import index as ix
from quillspark.plans import profile
from quillspark.plans.work import work_root
from quillspark.sources import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A line that many documents share, as terms.
LINE = "the and attion to thanedble the anea eriner thanea".split()

_T = "t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x[1:64])) AS tk FROM documents)"
_P = _T + ", p AS (SELECT doc_id, unnest(tk) AS term, CAST(unnest(range(len(tk))) AS INTEGER) AS pos FROM t)"
_F = _P + ", f AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, list(pos ORDER BY pos) AS positions FROM p GROUP BY ALL)"
_D = _F + ", d AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf, max(tf) AS max_tf FROM f GROUP BY term)"
_L = "l AS (SELECT doc_id, CAST(len(tk) AS BIGINT) AS len, CAST(greatest(1, least(255, len(tk))) AS INTEGER) AS norm FROM t)"


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def _scan(name: str, run: Callable[[match.TextScan], DataFrame], sql: str) -> None:
    add(name, lambda s, d: run(match.TextScan(documents(s, d))), sql)


def _index(name: str, run: Callable[[ix.Index], DataFrame], sql: str) -> None:
    add(name, lambda s, d: run(ix.build(documents(s, d))), sql)


def _phrase_sql(terms: list[str], last_prefix: bool = False) -> str:
    steps = " ".join(f"JOIN p p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND " + (f"starts_with(p{i}.term, '{t}')" if last_prefix and i == len(terms) - 1 else f"p{i}.term = '{t}'") for i, t in enumerate(terms) if i)
    return f"WITH {_P} SELECT DISTINCT p0.doc_id FROM p p0 {steps} WHERE p0.term = '{terms[0]}'"


def _has(condition: str) -> str:
    return f"WITH {_P} SELECT DISTINCT doc_id FROM p WHERE {condition}"


# analyzers and postings
add("tokenize", lambda s, d: ix.tokens(documents(s, d)), f"WITH {_P} SELECT doc_id, pos, term FROM p")
add("keyword_tokens", lambda s, d: ix.tokens(documents(s, d), "lang", "keyword"), "SELECT doc_id, 0 AS pos, lang AS term FROM documents WHERE lang <> ''")
add("normalize_bytes", lambda s, d: documents(s, d).select("doc_id", A.normalize_bytes(F.col("text")).alias("folded")), "SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')) AS folded FROM documents")
add("postings", lambda s, d: ix.postings_of(documents(s, d)).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")), f"WITH {_F} SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM f")
_index("dictionary", lambda i: i.dictionary, f"WITH {_D} SELECT * FROM d")
_index("norms", lambda i: i.lengths, f"WITH {_T}, {_L} SELECT * FROM l")
_index("block_stats", lambda i: ix.windows_of(i.postings), f"""WITH {_F}, {_L}, r AS (SELECT f.*, norm, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY term) AS df FROM f JOIN l USING (doc_id))
SELECT term, CAST(r // CASE WHEN df >= 8192 THEN 1024 ELSE 256 END AS BIGINT) AS block, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, max(tf) AS max_tf, min(norm) AS min_norm FROM r GROUP BY ALL""")
_index("block_ranges", lambda i: i.blocks, f"WITH {_F}, {_L} SELECT term, doc_id // 4096 AS block, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, max(tf) AS max_tf, min(norm) AS min_norm FROM f JOIN l USING (doc_id) GROUP BY ALL")
_FAULTS = "coalesce(sum(CASE WHEN len(positions) <> tf THEN 1 ELSE 0 END), 0)::BIGINT AS bad_tf, coalesce(sum(CASE WHEN positions[1] < 0 OR list_sort(list_distinct(positions)) <> positions THEN 1 ELSE 0 END), 0)::BIGINT AS bad_order, (count(*) - count(DISTINCT (term, doc_id)))::BIGINT AS bad_doc"
_index("validate_postings", lambda i: ix.faults(i.postings), f"WITH {_F} SELECT {_FAULTS} FROM f")
_index("validate_broken_postings", lambda i: ix.faults(_broken(i.postings)), f"""WITH {_F}, b AS (SELECT term, doc_id, CASE WHEN doc_id % 10 = 1 THEN tf + 1 ELSE tf END AS tf, CASE WHEN doc_id % 10 = 2 THEN list_reverse(positions) ELSE positions END AS positions FROM f
  UNION ALL SELECT term, doc_id, tf, positions FROM f WHERE doc_id % 10 = 3) SELECT {_FAULTS} FROM b""")


def _broken(postings: DataFrame) -> DataFrame:
    """Postings with faults of every kind, for the validation to count."""
    tens = F.col("doc_id") % 10
    faulty = postings.withColumn("tf", F.when(tens == 1, F.col("tf") + 1).otherwise(F.col("tf"))).withColumn("positions", F.when(tens == 2, F.reverse("positions")).otherwise(F.col("positions")))
    return faulty.withColumn("copy", F.explode(F.when(tens == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")  # in one pass: a union would analyze the texts twice


add("source_text_column", lambda s, d: _texts(s, d), "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.text_column(spark, f"{sf_dir}/documents.parquet", "text").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# matching, scan plans
_scan("term", lambda m: m.term("attion"), _has("term = 'attion'"))
_scan("term_high_df", lambda m: m.term("the"), _has("term = 'the'"))
_scan("term_absent", lambda m: m.term("zzqabsent"), _has("term = 'zzqabsent'"))
_scan("match_any", lambda m: m.any_of(["attion", "eriner", "und"]), _has("term IN ('attion', 'eriner', 'und')"))
_scan("match_any_dup", lambda m: m.any_of(["und", "und", "zzqabsent"]), _has("term = 'und'"))
_scan("match_all_terms", lambda m: m.all_of(["the", "of", "and", "the"]), f"WITH {_P} SELECT doc_id FROM p WHERE term IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
_scan("match_all_empty", lambda m: m.all_of([]), "SELECT doc_id FROM documents WHERE false")
_scan("match_all", lambda m: m.everything(), "SELECT doc_id FROM documents")
_scan("prefix", lambda m: m.prefix("thane"), _has("starts_with(term, 'thane')"))
_scan("prefix_empty", lambda m: m.prefix(""), f"WITH {_T} SELECT doc_id FROM t WHERE len(tk) > 0")
_scan("wildcard", lambda m: m.wildcard("t?an*ble"), _has("term GLOB 't?an*ble'"))
_scan("regexp", lambda m: m.regexp("(er){2,}[a-m]+|und"), _has("regexp_full_match(term, '(er){2,}[a-m]+|und')"))
for _n in (2, 3, 5, 8):
    _scan(f"phrase_{_n}", lambda m, n=_n: m.phrase(LINE[:n]), _phrase_sql(LINE[:_n]))
_scan("phrase_repeated", lambda m: m.phrase(["the", "the"]), _phrase_sql(["the", "the"]))
_scan("phrase_reversed", lambda m: m.phrase(LINE[3::-1]), _phrase_sql(LINE[3::-1]))
_scan("phrase_prefix", lambda m: m.phrase_prefix(["the", "and", "att"]), _phrase_sql(["the", "and", "att"], True))
_scan("phrase_prefix_single", lambda m: m.phrase_prefix(["thaned"]), _has("starts_with(term, 'thaned')"))

# matching, index plans
_index("index_term", lambda i: i.term("attion"), _has("term = 'attion'"))
_index("index_match_all_terms", lambda i: i.all_of(["the", "of", "and"]), SQL["match_all_terms"])
_index("index_and_rare_first", lambda i: i.all_of_rare_first(["the", "eriner"], i.dictionary), f"WITH {_P} SELECT doc_id FROM p WHERE term IN ('the', 'eriner') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
_index("index_phrase_5", lambda i: i.phrase(LINE[:5]), SQL["phrase_5"])
_index("index_phrase_repeated", lambda i: i.phrase(["the", "the"]), SQL["phrase_repeated"])
_index("index_phrase_prefix", lambda i: i.phrase_prefix(["the", "and", "att"]), SQL["phrase_prefix"])
_index("index_prefix", lambda i: i.prefix("thane"), SQL["prefix"])
_index("index_wildcard", lambda i: i.wildcard("t?an*ble"), SQL["wildcard"])
_index("index_regexp", lambda i: i.regexp("(er){2,}[a-m]+|und"), SQL["regexp"])
_index("term_expansion", lambda i: i.terms_like(lambda t: F.length(t) >= 24), _has("length(term) >= 24"))
_index("docid_union", lambda i: match.union_ids(i.term("attion"), i.term("und"), i.term("eriner")), SQL["match_any"])

# keyword fields
_KEY = ix.Field("lang", "keyword", ix.Config.DOCS, 1, "lang")
_keyword = lambda column, run: lambda s, d: run(match.KeywordScan(documents(s, d), column))
add("keyword_exact", _keyword("lang", lambda m: m.term("de")), "SELECT doc_id FROM documents WHERE lang = 'de'")
add("keyword_any", _keyword("lang", lambda m: m.any_of(["de", "fr", "zz"])), "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr', 'zz')")
add("keyword_prefix", _keyword("source", lambda m: m.prefix("src1")), "SELECT doc_id FROM documents WHERE starts_with(source, 'src1')")
add("keyword_wildcard", _keyword("source", lambda m: m.wildcard("src?")), "SELECT doc_id FROM documents WHERE source GLOB 'src?'")
add("keyword_regexp", _keyword("source", lambda m: m.regexp("src[0-4]|src1.")), "SELECT doc_id FROM documents WHERE regexp_full_match(source, 'src[0-4]|src1.')")
add("multi_field_and", lambda s, d: match.TextScan(documents(s, d)).term("und").join(match.KeywordScan(documents(s, d), "lang").term("de"), "doc_id", "left_semi"), f"WITH {_P} SELECT DISTINCT p.doc_id FROM p JOIN documents USING (doc_id) WHERE term = 'und' AND lang = 'de'")

# statistics
_ASKED = ["the", "und", "eriner", "zzqabsent"]
add("doc_freq", lambda s, d: statistics.of_terms(s, ix.build(documents(s, d)).dictionary, _ASKED).select("term", "df"), f"WITH {_D} SELECT a.term, coalesce(df, 0) AS df FROM (VALUES ('the'), ('und'), ('eriner'), ('zzqabsent')) a(term) LEFT JOIN d USING (term)")
add("total_term_freq", lambda s, d: statistics.of_terms(s, ix.build(documents(s, d)).dictionary, _ASKED).select("term", "ttf"), f"WITH {_D} SELECT a.term, coalesce(ttf, 0) AS ttf FROM (VALUES ('the'), ('und'), ('eriner'), ('zzqabsent')) a(term) LEFT JOIN d USING (term)")
_index("prefix_terms", lambda i: statistics.prefix_terms(i.dictionary, "than"), f"WITH {_D} SELECT term FROM d WHERE starts_with(term, 'than')")
_index("lookup", lambda i: statistics.lookup(i.dictionary, "attion"), f"WITH {_D} SELECT * FROM d WHERE term = 'attion'")
_SEGMENT = f"WITH {_D} SELECT (SELECT count(*) FROM t) AS doc_count, (SELECT count(*) FROM t) AS indexed_doc_count, (SELECT count(*) FROM d) AS term_count, (SELECT CAST(sum(len(tk)) AS BIGINT) FROM t) AS sum_total_term_freq, CAST(0 AS BIGINT) AS null_count, (SELECT sum(len(tk)) / count(*) FROM t) AS avgdl"
_index("segment_stats", lambda i: i.stats, _SEGMENT)
_index("avgdl", lambda i: i.doc_stats.select(F.round("avgdl", 9).alias("avgdl")), f"WITH {_T} SELECT round(sum(len(tk)) / greatest(1, count(*)), 9) AS avgdl FROM t")
_PICK = f"WITH {_D}, k AS (SELECT * FROM d WHERE term <> (SELECT max(term) FROM d))"
_index("df_bucket", lambda i: statistics.in_df_bucket(i.dictionary, 5, 20), f"{_PICK} SELECT term, df FROM k WHERE df BETWEEN 5 AND 20 ORDER BY term LIMIT 1")
_index("term_at_df", lambda i: statistics.at_df(i.dictionary, 37), f"{_PICK} SELECT term, df FROM k ORDER BY abs(df - 37), term LIMIT 1")
_index("df1_term", lambda i: statistics.in_df_bucket(i.dictionary, 1, 1), f"{_PICK} SELECT term, df FROM k WHERE df = 1 ORDER BY term LIMIT 1")
_index("highest_df_term", lambda i: statistics.highest_df(i.dictionary), f"{_PICK} SELECT term, df FROM k ORDER BY df DESC, term LIMIT 1")
_index("lowest_df_term", lambda i: statistics.lowest_df(i.dictionary), f"{_PICK} SELECT term, df FROM k ORDER BY df, term LIMIT 1")
_index("middle_df_term", lambda i: statistics.middle_df(i.dictionary), f"{_PICK} SELECT term, df FROM k ORDER BY df, term LIMIT 1 OFFSET (SELECT CAST(count(*) // 2 AS BIGINT) FROM k)")
_index("absent_token", lambda i: statistics.absent(i.dictionary), f"WITH {_D} SELECT 'zzq' || n AS term FROM range(CAST((SELECT count(*) + 1 FROM d) AS BIGINT)) r(n) WHERE 'zzq' || n NOT IN (SELECT term FROM d) ORDER BY n LIMIT 1")
_index("absent_token_taken", lambda i: statistics.absent(i.dictionary.select("term").unionByName(i.dictionary.sparkSession.range(5000).select(F.concat(F.lit("zzq"), F.col("id").cast("string")).alias("term"))).where("term <> 'zzq4321'")), "SELECT 'zzq4321' AS term")
add("norm_of_document", lambda s, d: ix.lengths_of(documents(s, d)).where("doc_id in (3, 50, 77)").select("doc_id", "norm"), f"WITH {_T}, {_L} SELECT doc_id, norm FROM l WHERE doc_id IN (3, 50, 77)")
_index("cooccurring", lambda i: statistics.cooccurring(i.postings, i.dictionary, (20, 60), (2, 9)), f"""{_PICK}, a AS (SELECT term FROM k WHERE df BETWEEN 20 AND 60 ORDER BY term LIMIT 1)
SELECT a.term AS a, o.term AS b, o.doc_id FROM a JOIN f x ON x.term = a.term JOIN f o ON o.doc_id = x.doc_id AND o.term <> a.term WHERE o.term IN (SELECT term FROM k WHERE df BETWEEN 2 AND 9) ORDER BY o.doc_id, o.positions[1] LIMIT 1""")
add("extract_phrase", lambda s, d: statistics.first_phrase(ix.tokens(documents(s, d)), 5, "the"), f"""WITH {_P}, w AS (SELECT doc_id, pos, list(term) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM p)
SELECT doc_id, pos, array_to_string(w, ' ') AS phrase FROM w WHERE len(w) = 5 AND NOT list_contains(w, 'the') ORDER BY doc_id, pos LIMIT 1""")


# ranking
def _bm25_sql(terms: list[str], k: int, p: Bm25 = Bm25(), least: float | None = None) -> str:
    parts = " + ".join(f"coalesce(max(CASE WHEN f.term = '{t}' THEN s END), 0.0)" for t in terms)
    names = ", ".join(f"'{t}'" for t in dict.fromkeys(terms))
    return f"""WITH {_D}, {_L}, g AS (SELECT count(*) AS n, sum(len) / count(*) AS avgdl FROM l),
s AS (SELECT f.term, f.doc_id, ln(1.0 + (g.n - d.df + 0.5) / (d.df + 0.5)) * (f.tf * {p.k1 + 1.0}) / (f.tf + {p.k1} * ({1.0 - p.b} + {p.b} * (l.norm / g.avgdl))) AS s
  FROM f JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN g WHERE f.term IN ({names}))
SELECT doc_id, round(score, 9) AS score FROM (SELECT doc_id, {parts} AS score FROM s f GROUP BY doc_id) {f'WHERE score >= {least}' if least is not None else ''} ORDER BY score DESC, doc_id LIMIT {k}"""


_RANKED = ["thanedble", "und", "thing"]
add("bm25_topk", lambda s, d: rank.top_k_texts(documents(s, d), _RANKED, 10), _bm25_sql(_RANKED, 10))
add("bm25_topk_params", lambda s, d: rank.top_k_texts(documents(s, d), _RANKED, 25, Bm25(0.9, 0.4)), _bm25_sql(_RANKED, 25, Bm25(0.9, 0.4)))
add("bm25_dup_terms", lambda s, d: rank.top_k_texts(documents(s, d), ["und", "thing", "und", "zzqabsent"], 20), _bm25_sql(["und", "thing", "und", "zzqabsent"], 20))
add("bm25_min_score", lambda s, d: rank.top_k_texts(documents(s, d), _RANKED, 1000, min_score=3.0), _bm25_sql(_RANKED, 1000, least=3.0))
_index("bm25_index", lambda i: i.top_k(_RANKED, 50), _bm25_sql(_RANKED, 50))
_index("bm25_blockmax", lambda i: i.top_k_block_max(_RANKED, 50), _bm25_sql(_RANKED, 50))
_index("bm25_ties", lambda i: i.top_k(["thanedble"], 200), _bm25_sql(["thanedble"], 200))


def _splits(df: DataFrame, least: int) -> int:
    """How many parts a table is read in, so that dealing it out again makes no task read more as it grows; `least` if they are fewer."""
    return max(least, df.rdd.getNumPartitions())


# shards, persisted and streamed indexes
def _sharded(spark: SparkSession, sf_dir: str, index_id: int = 0, suffix: str = "") -> ix.Index:
    """Two shards, by halves of the doc_ids, of two fields each, opened as one index."""
    root, docs = work_root(spark, "index"), documents(spark, sf_dir)
    half = docs.agg(F.floor(F.max("doc_id") / 2)).first()[0]
    ix.write(docs, root, [ix.Field("text"), _KEY], F.when(F.col("doc_id") <= half, "0").otherwise("1"))
    return ix.open_index(spark, root, index_id, suffix)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.streaming.incremental import index_stream

    root, found = work_root(spark, "index"), work_root(spark, "arrivals")
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw.repartition(_splits(raw, 3)).write.parquet(found)
    stream = spark.readStream.schema(raw.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(found)
    index_stream(stream.select("doc_id", "text"), root, [ix.Field("text")], f"{root}-log").awaitTermination()
    return ix.open_index(spark, root).top_k(_RANKED, 50)


def _both_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields of one stored index, each opened by its id and suffix."""
    root = work_root(spark, "index")
    ix.write(documents(spark, sf_dir), root, [ix.Field("text"), _KEY])
    return ix.open_index(spark, root).term("und").join(ix.open_index(spark, root, 1, "lang").term("de"), "doc_id", "left_semi")


add("shard_merge", lambda s, d: _sharded(s, d).phrase(LINE[:3]), SQL["phrase_3"])
add("shard_bm25", lambda s, d: _sharded(s, d).top_k_block_max(_RANKED, 50), _bm25_sql(_RANKED, 50))
add("stored_second_field", lambda s, d: _sharded(s, d, 1, "lang").term("de"), SQL["keyword_exact"])
add("stored_both_fields", _both_fields, SQL["multi_field_and"])
add("stream_index_bm25", _streamed, _bm25_sql(_RANKED, 50))


# sources, profile
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as lines of files, in the order of doc_id."""
    root = work_root(spark, "lines")
    rows = documents(spark, sf_dir).select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("value"))
    rows.repartitionByRange(_splits(rows, 4), "doc_id").sortWithinPartitions("doc_id").select("value").write.text(root)
    return corpora.text_lines(spark, root).select("doc_id", F.md5("text").alias("text_md5"))


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink receives of a query, and whether its profile has time, rows, files and bytes."""
    ids, p = profile.run(match.TextScan(documents(spark, sf_dir)).term("attion"), lambda df: sorted(r["doc_id"] for r in df.collect()))
    return spark.createDataFrame([(len(ids), p.rows, p.elapsed_ns >= 1, p.files >= 1 and p.read_bytes >= 1)], "received long, n_rows long, timed boolean, read boolean")


def _throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four queries on four threads: whether there is a rate, and percentiles ascend."""
    m = match.TextScan(documents(spark, sf_dir))
    t = profile.throughput([lambda: m.term("attion"), m.everything, lambda: m.prefix("thane"), lambda: m.phrase(LINE[:2])])
    return spark.createDataFrame([(t["qps"] > 0, 0 < t["p50_ms"] <= t["p90_ms"] <= t["p99_ms"])], "rate boolean, ordered boolean")


_ZIPF = (2000, 500)
_U = "(CAST('0x' || md5('42-' || id || '-' || {}) [1:12] AS BIGINT) + 0.5) / 281474976710656.0"
add("source_text_lines", _lines, "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_id, md5(translate(coalesce(text, ''), chr(10) || chr(13), '  ')) AS text_md5 FROM documents")
add(
    "source_zipf",
    lambda s, d: corpora.zipf(s, *_ZIPF).select("doc_id", F.array_join("tokens", " ").alias("tokens")),
    f"""WITH d AS (SELECT id, CAST(6 + floor({_U.format("'-1'")} * 12) AS INTEGER) AS n, {_U.format("'-2'")} < 0.7 AS anchor FROM range({_ZIPF[0]}) r(id)),
w AS (SELECT id, i, least({_ZIPF[1] - 1}, CAST(trunc(pow(1.0 + {_U.format("i")} * (pow(CAST({_ZIPF[1] + 1} AS DOUBLE), CAST(1.0 - 1.1 AS DOUBLE)) - 1.0), 1.0 / (CAST(1.0 AS DOUBLE) - CAST(1.1 AS DOUBLE))) - 1) AS INTEGER)) AS k FROM d, range(1, 20) g(i) WHERE i <= greatest(n, 1)),
j AS (SELECT id, string_agg(printf('w%07d', k), ' ' ORDER BY i) AS words FROM w GROUP BY id)
SELECT CAST(id AS BIGINT) AS doc_id, CASE WHEN anchor THEN 'w0000000 ' ELSE '' END || words AS tokens FROM d JOIN j USING (id)""",
)
add("query_profile", _profiled, f"WITH {_P}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p WHERE term = 'attion') SELECT n AS received, n AS n_rows, true AS timed, true AS read FROM n")
add("throughput_run", _throughput, 'SELECT true AS rate, true AS "ordered"')
