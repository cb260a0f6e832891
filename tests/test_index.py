"""Matching and ranking against brute force over token lists, on random corpora."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.arrow import BATCH_BYTES, BATCH_ROWS
from quillspark.functions.analyzers import analyze
from quillspark.functions.scoring import Bm25
from quillspark.operators import match, rank, statistics
from quillspark.plans import index as ix
from quillspark.plans import work
from quillspark.plans.profile import Profile, percentile, run, throughput

STEMS = ["ora", "oran", "orange", "kel", "kelp", "mu"]


def corpus(n, seed):
    """Short texts over words that begin alike, with separators of all kinds, repeated words, empty and null texts."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(STEMS).title() if rng.random() < 0.2 else rng.choice(STEMS) for _ in range(rng.randint(0, 9))]
        out.append(rng.choice([" ", ", ", "-", "é"]).join(words))
    return [*out, "", None, "...", "q" * 70 + " mu"]


TEXTS = corpus(60, 1)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ids(df):
    out = [r["doc_id"] for r in df.collect()]
    assert len(out) == len(set(out))
    return sorted(out)


def having(test):
    return [i for i, t in enumerate(TEXTS) if test(analyze(t))]


def phrase(texts, terms, last_prefix=False):
    def at(t, p):
        return all(p + k < len(t) and (t[p + k].startswith(w) if last_prefix and k == len(terms) - 1 else t[p + k] == w) for k, w in enumerate(terms))

    return [i for i, x in enumerate(texts) if any(at(analyze(x), p) for p in range(len(analyze(x))))] if terms else []


@pytest.fixture(scope="module")
def plans(spark, tmp_path_factory):
    """Scan, index in memory, stored index."""
    docs, root = frame(spark, TEXTS), f"file://{tmp_path_factory.mktemp('index')}"
    ix.write(docs, root, [ix.Field("text")], F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"), block_docs=8)
    assert sorted(ix.shards(spark, root)) == ["x", "y"]
    return match.TextScan(docs), ix.build(docs), ix.open_index(spark, root)


def test_phrases(plans):
    rng = random.Random(2)
    for plan in plans:
        for _ in range(4):
            terms = rng.choices([*STEMS, "no"], k=rng.randint(1, 4))
            assert ids(plan.phrase(terms)) == phrase(TEXTS, terms), terms
            terms[-1] = rng.choice(["o", "or", "k", "kelp", "mu", "x"])
            assert ids(plan.phrase_prefix(terms)) == phrase(TEXTS, terms, True), terms


def test_terms(plans):
    for plan in plans:
        assert ids(plan.term("no")) == ids(plan.any_of([])) == ids(plan.all_of([])) == ids(plan.phrase([])) == ids(plan.phrase_prefix([])) == ids(plan.wildcard("")) == []
        assert ids(plan.term("kel")) == ids(plan.all_of(["kel", "kel"])) == having(lambda t: "kel" in t)
        assert ids(plan.all_of(["mu", "ora", "mu"])) == having(lambda t: {"mu", "ora"} <= set(t)) and ids(plan.all_of(["mu", "no"])) == []
        assert ids(plan.any_of(["orange", "no", "orange", "kelp"])) == having(lambda t: {"orange", "kelp"} & set(t))
        assert ids(plan.prefix("oran")) == having(lambda t: any(w.startswith("oran") for w in t))
        assert ids(plan.prefix("")) == having(bool) and ids(plan.everything()) == list(range(len(TEXTS)))
        assert ids(plan.wildcard("?el*")) == having(lambda t: {"kel", "kelp"} & set(t)) and ids(plan.regexp("m.|ora")) == having(lambda t: {"mu", "ora"} & set(t))
        assert ids(plan.term("q" * 64)) == [len(TEXTS) - 1]
        with pytest.raises(ValueError):
            plan.regexp("(")


def test_phrases_of_any_length(spark):
    words = [f"t{i % 90}" for i in range(130)]
    docs = frame(spark, [" ".join(words), " ".join(words[:100] + ["gap"] + words[100:]), " ".join(words[1:])])
    for plan in (match.TextScan(docs), ix.build(docs)):
        assert ids(plan.phrase(words[:100])) == [0, 1] and ids(plan.phrase(words)) == [0] and ids(plan.phrase([*words[:70], "no"])) == []
        assert ids(plan.phrase_prefix([*words[:69], "t6"])) == [0, 1] and ids(plan.phrase(words[1:64])) == [0, 1, 2]


def test_documents_only(spark):
    index = ix.build(frame(spark, TEXTS), ix.Field("text", config=ix.Config.DOCS))
    assert ids(index.term("kel")) == having(lambda t: "kel" in t) and ids(index.phrase_prefix(["kel"])) == ids(index.prefix("kel"))
    for call, terms in ((index.phrase, ["kel"]), (index.phrase, ["kel", "mu"]), (index.phrase_prefix, ["kel", "mu"])):  # positions are asked for before the number of terms
        with pytest.raises(NotImplementedError):
            call(terms)
    assert ids(index.phrase([])) == []
    with pytest.raises(ValueError):
        index.top_k(["kel"])
    with pytest.raises(TypeError):
        ix.build(frame(spark, TEXTS), ix.Field("doc_id"))


def test_statistics(spark, plans):
    terms = [w for t in TEXTS for w in analyze(t)]
    for index in plans[1:]:
        row = index.stats.first()
        assert (row["doc_count"], row["sum_total_term_freq"], row["term_count"], row["null_count"]) == (len(TEXTS), len(terms), len(set(terms)), 0)
        assert {r["term"]: (r["df"], r["ttf"]) for r in index.dictionary.collect()} == {w: (sum(w in analyze(t) for t in TEXTS), terms.count(w)) for w in set(terms)}
        assert statistics.norm_of(index.lengths, len(TEXTS) - 2) == 1
        with pytest.raises(ValueError):
            statistics.norm_of(index.lengths, 999)
    names = [f"zzq{i}" for i in range(3000) if i != 2345] + ["zzq", "zzq007", "zzqx", "zzq99999999999999999999", "other"]
    dictionary = spark.createDataFrame([(t,) for t in names], "term string")
    assert [r["term"] for r in statistics.absent(dictionary).collect()] == ["zzq2345"]
    assert [r["term"] for r in statistics.absent(dictionary.where("term <> 'zzq0'")).collect()] == ["zzq0"]
    rng = random.Random(3)
    rows = [(f"t{i:04d}", rng.choice([1, 1, 1, 2, 5])) for i in range(1001)]
    ranked = sorted(rows[:-1], key=lambda r: (r[1], r[0]))  # without the last term
    assert [tuple(r) for r in statistics.middle_df(spark.createDataFrame(rows, "term string, df int")).collect()] == [ranked[500]]
    assert statistics.middle_df(spark.createDataFrame([], "term string, df int")).count() == 0


def test_faults_are_counted(spark):
    rows = [("a", 1, 2, [0, 3]), ("a", 2, 1, [0, 3]), ("a", 3, 2, [3, 3]), ("b", 1, 2, [4, 1]), ("b", 2, 1, [-1]), ("c", 1, 1, [5]), ("c", 1, 1, [5]), ("c", 1, 1, [6])]
    bad = spark.createDataFrame(rows, "term string, doc_id long, tf int, positions array<int>")
    assert ix.faults(bad).first() == (1, 3, 2) and ix.faults(bad.limit(0)).first() == (0, 0, 0)


def test_windows_across_parts(spark):
    rng = random.Random(4)
    rows = [("hot", i * 7, rng.randint(1, 9), rng.randint(1, 255)) for i in range(2000)] + [(f"t{i % 50}", i, 1, 3) for i in range(400)]
    got = ix.windows_of(spark.createDataFrame(rows, "term string, doc_id long, tf int, norm int").repartition(7), 16, 64, 1000)
    lists, want = {}, set()
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        lists.setdefault(r[0], []).append(r)
    for term, v in lists.items():
        step = 64 if len(v) >= 1000 else 16
        want |= {(term, k // step, v[k][1], v[k : k + step][-1][1], len(v[k : k + step]), max(x[2] for x in v[k : k + step]), min(x[3] for x in v[k : k + step])) for k in range(0, len(v), step)}
    assert {tuple(r) for r in got.collect()} == want


def in_short_batches(function):
    """function, which fails if it gets a batch of more rows or bytes than a worker should hold at once."""

    def run(batches):
        def short():
            for b in batches:
                assert b.num_rows <= BATCH_ROWS and b.nbytes <= 2 * BATCH_BYTES, f"a batch of {b.num_rows} rows, {b.nbytes} bytes"
                yield b

        return function(short())

    return run


def long_texts(spark):
    """2000 short texts, then 200 of 60,000 bytes, in one partition."""
    text = F.when(F.col("id") < 2000, F.lit("ora mu ora")).otherwise(F.repeat(F.concat(F.lit("t"), F.col("id") % 7, F.lit(" kelp "), F.col("id"), F.lit(" ")), 5000))
    return spark.range(0, 2200, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))


def test_postings_are_made_in_short_batches(spark, monkeypatch):
    """A worker's memory follows its batches, so those must not grow with the rows of a task or the lengths of texts."""
    monkeypatch.setattr(ix, "_grouped", in_short_batches(ix._grouped))
    index = ix.build(long_texts(spark))
    assert {r["term"]: (r["df"], r["ttf"], r["max_tf"]) for r in index.dictionary.where("term in ('ora', 'mu', 'kelp')").collect()} == {"ora": (2000, 4000, 2), "mu": (2000, 2000, 1), "kelp": (200, 1_000_000, 5000)}
    assert ix.faults(index.postings).first() == (0, 0, 0) and index.postings.where("term = 'kelp' and norm = 255 and tf = 5000 and positions[1] = 4").count() == 200


def test_stored_postings_are_made_in_short_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ix, "_grouped_in_shards", in_short_batches(ix._grouped_in_shards))
    docs = long_texts(spark).where("doc_id % 4 = 1")
    ix.write(docs, f"file://{tmp_path}/i", [ix.Field("text")], F.when(F.col("doc_id") % 8 == 1, "x").otherwise("y"))
    index = ix.open_index(spark, f"file://{tmp_path}/i")
    assert {r["term"]: (r["df"], r["ttf"], r["max_tf"]) for r in index.dictionary.where("term in ('ora', 'mu', 'kelp')").collect()} == {"ora": (500, 1000, 2), "mu": (500, 500, 1), "kelp": (50, 250_000, 5000)}


def brute_bm25(texts, terms, k, p=Bm25()):
    docs = [analyze(t) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / max(1, len(docs))
    out = []
    for i, d in enumerate(docs):
        if not set(d) & set(terms):
            continue
        s = 0.0
        for t in terms:
            tf, df = d.count(t), sum(t in x for x in docs)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * max(1, min(255, len(d))) / avg))
        out.append((i, s))
    return sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:k]


def test_bm25_all_plans(spark, tmp_path):
    rng = random.Random(7)
    words = [f"u{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.choice([0, 1, 4, 15, 60]))) for _ in range(200)]
    texts += [*texts[:60], None, "u0 " * 400]  # ties
    docs = frame(spark, texts)
    ix.write(docs.where("doc_id < 120"), str(tmp_path), [ix.Field("text")], "a", block_docs=32)
    ix.write(docs.where("doc_id >= 120"), str(tmp_path), [ix.Field("text")], "b", block_docs=32)
    stored, built = ix.open_index(spark, str(tmp_path)), ix.build(docs, block_docs=32)
    for _ in range(3):
        terms, k = rng.choices([*words[:3], words[20], words[39], "none"], k=rng.randint(1, 4)), rng.choice([1, 5, 40])
        want = brute_bm25(texts, terms, k)
        for got in (stored.top_k(terms, k), stored.top_k_block_max(terms, k), built.top_k(terms, k), built.top_k_block_max(terms, k), rank.top_k_texts(docs, terms, k)):
            rows = [(r["doc_id"], r["score"]) for r in got.collect()]
            assert [i for i, _ in rows] == [i for i, _ in want]
            assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(rows, want, strict=True))
    assert stored.top_k(["u0"], 0).count() == built.top_k([], 5).count() == 0
    with pytest.raises(KeyError):
        ix.open_index(spark, str(tmp_path), 9, "none")
    assert ix.faults(stored.postings).first() == (0, 0, 0)


def test_stored_fields_and_failed_writes(spark, tmp_path):
    """Fields are opened by id and suffix; a shard isn't written twice; a write that fails is never seen; two writers can't publish the same state."""
    root = f"file://{tmp_path}/i"
    docs = frame(spark, TEXTS).withColumn("key", F.concat(F.lit("K "), F.col("doc_id") % 4))
    fields = [ix.Field("text"), ix.Field("key", "keyword", ix.Config.DOCS, 1, "key"), ix.Field("text", "english", ix.Config.POSITIONS, 2)]
    ix.write(docs, root, fields)
    assert ids(ix.open_index(spark, root, 1, "key").term("K 2")) == [i for i in range(len(TEXTS)) if i % 4 == 2]
    assert ids(ix.open_index(spark, root, 2).phrase(["mu", "mu"])) == phrase(TEXTS, ["mu", "mu"])
    for i, s in ((2, ""), (1, "key")):
        with pytest.raises(ValueError):
            ix.open_index(spark, root, i, s).top_k(["mu"])
    with pytest.raises(ValueError):
        ix.write(docs, root, fields)
    with pytest.raises(Exception, match="no luck"):
        ix.write(docs.withColumn("text", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("no luck"))).otherwise(F.col("text"))), root, fields, "late")
    assert ix.shards(spark, root) == ["0"] and ix.open_index(spark, root).everything().count() == len(TEXTS)
    with pytest.raises(RuntimeError):
        work.Manifest(spark, root).publish(0, [])
    empty = f"file://{tmp_path}/e"
    ix.write(docs.limit(0), empty, fields)
    assert ix.open_index(spark, empty).term("mu").count() == 0 and ix.open_index(spark, empty).top_k(["mu"], 3).count() == 0


def test_bloom_filter_is_written(spark, tmp_path):
    ix.write(frame(spark, TEXTS), f"file://{tmp_path}/b", [ix.Field("text")])
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for file in tmp_path.glob("b/data/*/postings/**/*.parquet"):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(file)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        for group in reader.getFooter().getBlocks():
            column = next(c for c in group.getColumns() if c.getPath().toDotString() == "term")
            bloom = reader.readBloomFilter(column)
            binary = jvm.org.apache.parquet.io.api.Binary
            terms = {r["term"] for r in spark.read.parquet(str(file)).select("term").collect()}
            assert all(bloom.findHash(bloom.hash(binary.fromString(t))) for t in terms)
            found += sum(not bloom.findHash(bloom.hash(binary.fromString(f"absent{k}"))) for k in range(50)) > 40
        reader.close()
    assert found


def test_profile(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/r")
    stored = spark.read.parquet(f"{tmp_path}/r")
    rows, p = run(stored)
    assert len(rows) == p.rows == 5 and p.elapsed_ns >= 1 and p.files >= 1 and p.read_bytes > 100
    failed = Profile()
    with pytest.raises(Exception, match="no luck"):
        run(stored.select(F.when(F.col("id") == 3, F.raise_error(F.lit("no luck"))).otherwise(F.col("id"))), profile=failed)
    assert failed.elapsed_ns >= 1 and failed.rows == 0 and failed.files >= 1

    def refuses(df):
        df.collect()
        raise OSError("sink")

    with pytest.raises(OSError):
        run(stored, refuses)
    assert [percentile([4, 1, 3, 2], q) for q in (50, 90, 99)] == [2, 4, 4]
    t = throughput([lambda: stored, lambda: stored.where("id > 2")], threads=2)
    assert t["qps"] > 0 and 0 < t["p50_ms"] <= t["p90_ms"] <= t["p99_ms"]
