"""The pipeline: run() against a brute-force version of all stages, stages one by one, and awkward tables."""

import itertools
import math
import os
import re
import sys
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillspark.llm import quality_rules, site_bayes
from quillspark.llm.common import in_arrow, worker_cache, written

from tests.llm.test_operators import brute_classes, brute_removed, words

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def brute_lines(text):
    """(kept, text without failing lines)."""
    w = words(text)
    starts = {}
    for i in range(len(w) - 7):
        starts.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeats = len({i + k for v in starts.values() if len(v) > 1 for i in v for k in range(8)})
    chars = lambda x: sum(c not in " \t\n\x0b\x0c\r" for c in x)

    def passes(line):
        bars = len(re.split(" [|>·•] ", line)) - 1
        return (
            re.search(quality_rules.SENTENCE.replace(r"\z", r"\Z"), line)
            and sum(c in "#*$%&|<>" for c in line) * 100 <= 6 * len(line)
            and line.count("!") * 100 <= 6 * len(line)
            and (bars < 2 or bars * 24 < len(line))
            and not any(re.search(p, line.lower()) for v in quality_rules.PHRASES.values() for p in v)
        )

    good = [x for x in (text or "").split("\n") if chars(x) and passes(x)]
    lost = chars(text or "") - sum(map(chars, good))
    return len(w) >= 20 and 100 * repeats <= 30 * len(w) and lost * 2 <= chars(text or ""), "\n".join(good)


def brute_good(rows, model):
    """Which rows (source, lang, text) the classifier keeps: its sums by site in plain loops."""
    chance = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    logit = lambda p: math.log(p / (1 - p))
    odds = [[model.bias[t] + sum(model.weights[t].get(f, 0.0) for f in site_bayes.features(x[2] or "")) for t in ("good", "toxic")] for x in rows]
    sites = [(x[0] or "", x[1] or "") for x in rows]
    paths, hosts = {}, {}
    for site, (good, _) in zip(sites, odds, strict=True):
        for table, key in ((paths, site), (hosts, site[0])):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + chance(good))

    def strength(groups):
        n = sum(g[0] for g in groups)
        noise = sum(m * (1 - m) * k for k, _, m in groups) / n
        between = sum(k * (s / k - m) ** 2 - m * (1 - m) for k, s, m in groups) / n
        return max(2.0, min(1000.0, noise / max(between, 1e-9) - 1))

    base = max(1e-6, min(1 - 1e-6, sum(s for _, s in hosts.values()) / len(rows)))
    k = strength([(n, s, base) for n, s in hosts.values()])
    rate = {h: (s + k * base) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s, rate[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for site, (good, toxic) in zip(sites, odds, strict=True):
        n, s = paths[site]
        p = max(1e-6, min(1 - 1e-6, (s - chance(good) + k * rate[site[0]]) / (n - 1 + k)))
        moved = max(-1.0, min(1.0, 0.5 * (logit(p) - logit(base))))
        out.append(chance(good + moved) >= 0.5 and chance(toxic) < model.limit)
    return out


def brute_run(spark, rows, labels):
    """rows (doc_id, text, lang, source) with unique ids -> {doc_id: text after all cleaning}."""
    kept = [(i, brute_lines(t)[1], lang, source) for i, t, lang, source in rows if brute_lines(t)[0]]
    assert 0 < len(kept) < len(rows)
    model = site_bayes.fit(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string"), labels)
    good = [r for r, ok in zip(kept, brute_good([(r[3], r[2], r[1]) for r in kept], model), strict=True) if ok]
    assert 0 < len(good) < len(kept)
    good.sort(key=lambda r: r[0])
    classes = brute_classes([r[1] for r in good], 5, 80)
    first = [r for k, r in enumerate(good) if classes[k][1] == k]
    assert 0 < len(first) < len(good)
    out = {}
    for r, gone in zip(first, brute_removed([r[1] for r in first]), strict=True):
        out[r[0]] = (r[1], gone)
    assert any(gone for _, gone in out.values())
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents of up to 3000 characters of sf0.01, every third of them, with null and empty texts, an untouched copy of a passage, and their labels."""
    root = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 3000")
    docs = docs.where("doc_id % 3 <> 1")
    shared = docs.where("lang = 'en' and length(text) > 900").orderBy("doc_id").limit(6)
    passage = shared.select(F.col("text")).first()[0].replace("\n", " ")[:500]
    with_passage = shared.select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit("\n" + passage + ".")).alias("text"), "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200_001, None, "en", "src1", None), (200_002, "", None, None, 0), (200_003, " \n ", "de", None, 3)], docs.schema)
    docs.unionByName(with_passage).unionByName(odd).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


def test_run_against_brute_force(spark, small):
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    want = brute_run(spark, rows, labels)
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces, sequences = {}, {}
    for r in got.collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    expected = {}
    for i, (text, gone) in want.items():
        left = b" ".join(w for k, w in enumerate(words(text)) if k not in gone).decode()  # the tokenizer drops white space
        ids = [*tokenizer.encode(left, add_special_tokens=False).ids, 0]
        parts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        expected[i] = [(k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    assert {i: sorted(v) for i, v in pieces.items()} == expected
    for v in sequences.values():
        assert [o for o, _ in sorted(v)] == list(itertools.accumulate([n for _, n in sorted(v)], initial=0))[:-1] and sum(n for _, n in v) <= 2048
    assert len(sequences) <= 1.02 * sum(n for v in sequences.values() for _, n in v) / 2048 + 1
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
        if name == "ngram_jaccard_join":
            rows = before.orderBy("doc_id").collect()
            classes = brute_classes([r["text"] for r in rows], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {rows[c]["doc_id"] for _, c in classes.values()}


def test_stages_on_awkward_tables(spark, small):
    """Null ids and texts, empty texts, repeated rows, columns of names that stages use: nothing fails, columns stay, and what can't be named stays."""
    text = "A line of words that is long enough to be kept, as it has more than twenty words in it and ends as it should, with a stop."
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, "short"), (6, f"{text} x {text} y {text}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "cast(null as string) as source", "1 as n_chars", "2 as kept", "3 as gone", "4 as _gone", "5 as component_id", "6 as sequence_id", "7 as key", "8 as q_text", "9 as digest", "10 as _m0", "11 as host", "12 as spans")
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert stage(spark, docs.limit(0), small).count() == 0
        got = out.collect()
        assert all(tuple(r)[5:] == tuple(range(2, 13)) for r in got)
        counts[name] = sorted((r["doc_id"] or -1) for r in got)
    assert counts["quality_rules"] == [-1, 1, 1, 2] or counts["quality_rules"] == [-1, 1, 1, 2, 6]
    assert counts["ngram_jaccard_join"] == [-1, -1, 1, 1, 3, 4, 5, 6] and counts["substring_dedup"] == [-1, -1, 1, 1, 2, 3, 4, 5, 6]
    assert set(counts["quality_classifier"]) >= {-1}
    packed = STAGES["best_fit_packing"](spark, docs, small)
    assert packed.count() == len(rows) and packed.select("sequence_id").distinct().count() == 1
    assert STAGES["best_fit_packing"](spark, docs.limit(0), small).count() == 0


def test_substring_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "substring(text, 1, 700) as text", "lang", "source", "n_chars")
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in STAGES["substring_dedup"](spark, docs, SF).collect()}
    removed = brute_removed([r["text"] for r in rows])
    assert len(got) == len(rows) and sum(map(len, removed)) > 100
    for r, gone in zip(rows, removed, strict=True):
        assert got[r["doc_id"]]["text"].encode().split() == [w for k, w in enumerate(r["text"].encode().split()) if k not in gone]
        assert got[r["doc_id"]]["n_chars"] == len(got[r["doc_id"]]["text"])


def own_mb(pid):
    """MB of a process without mapped files."""
    return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="malloc_trim is glibc's")
def test_workers_give_back_what_a_task_freed(spark):
    def run(batches):
        for _ in batches:
            blocks = [bytes([k % 251 + 1]) * 10_000 for k in range(15_000)]  # 150 MB in malloc's heap
            most = own_mb(os.getpid())
            worker_cache("a few blocks stay", lambda b=blocks: b[::1000] + b[-1:])  # so the heap can't shrink from its end
            del blocks
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([most], pa.float64())], names=["pid", "most"])

    (row,) = in_arrow(spark.range(0, 1, 1, 1), run, "pid long, most double").collect()
    assert row["most"] > 150 and own_mb(row["pid"]) < row["most"] - 100
