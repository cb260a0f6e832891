"""Every catalog query that has SQL against DuckDB on the smallest tables, for a spread of the queries."""

import glob
import os

import duckdb
import pytest

from quillspark import catalog

SF = "/root/testdata/sf0.001"
SOME = ["tokenize", "postings", "term", "match_any", "match_all_terms", "prefix_empty", "wildcard", "regexp", "phrase_3", "phrase_repeated", "index_phrase_5", "index_phrase_prefix", "keyword_exact", "segment_stats", "middle_df_term", "cooccurring", "bm25_topk", "bm25_blockmax", "stream_index_bm25", "validate_broken_postings", "source_text_lines", "source_zipf", "stored_both_fields", "query_profile"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, rows))


@pytest.fixture
def in_splits(spark):
    """Reads the tables in many splits, as a large table is."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield catalog.documents(spark, SF).rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def dealt(spark, monkeypatch, name):
    """The files that a query writes, by folder."""
    roots, make = {}, catalog.work_root
    monkeypatch.setattr(catalog, "work_root", lambda s, n: roots.setdefault(n, make(s, n)))
    rows = catalog.QUERIES[name](spark, SF).count()
    return rows, {n: len(glob.glob(f"{root.removeprefix('file://')}/part-*")) for n, root in roots.items()}


def test_lines_are_dealt_to_more_files_as_the_table_grows(spark, monkeypatch, in_splits):
    rows, files = dealt(spark, monkeypatch, "source_text_lines")
    assert rows == 200 and in_splits > 12 and files["lines"] > in_splits // 2


def test_arrivals_are_dealt_to_more_files_as_the_table_grows(spark, monkeypatch, in_splits):
    rows, files = dealt(spark, monkeypatch, "stream_index_bm25")
    assert rows == 50 and in_splits > 12 and files["arrivals"] > in_splits // 2


def test_broken_postings_are_made_in_one_pass(spark):
    """A union with the rows that are there twice would analyze all texts again."""
    plan = catalog.QUERIES["validate_broken_postings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_avgdl_makes_no_postings(spark):
    """Lengths are all it needs: a count of terms beside it would make, and group, the postings of all texts."""
    df = catalog.QUERIES["avgdl"](spark, SF)
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    tokens = catalog.QUERIES["tokenize"](spark, SF).count()
    assert [tuple(r) for r in df.collect()] == [(round(tokens / 200, 9),)]


def test_every_query_is_known():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
