"""Quality classifier with hierarchical empirical Bayes over sites.

A linear model on words and shape features gives each document its own evidence (log odds of being good, and of being toxic). Over all
documents the evidence is summed by path and host; a host's rate is shrunk toward the global rate, a path's toward its host's, by
Beta priors whose strengths are fitted to the spread between sites (method of moments). The path's posterior, without the
document itself, moves the document's log odds. Sparse sites therefore count for little and a hot site is only a few sums.

The linear model is fitted on at most `fit_rows` labelled documents, those with the least hash of doc_id; it is a bounded sample by
the contract. Everything else covers all rows. Null or empty texts have shape features only; a null host or path is a site of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_arrow, texts_of, without, written

#: Labelled rows that the model is fitted on at most; features that it keeps at most for each target.
FIT_ROWS, MAX_FEATURES = 4000, 300
#: Lengths of the beginnings of words that are features.
STEMS = (4, 5)
#: A feature is kept from this many documents and this z score on.
MIN_DOCS, MIN_Z = 8, 5.0
#: Penalty of a squared weight.
RIDGE = 0.2
#: Toxicity from which a document is rejected: the one of LIMITS with the least cost by cross-validation in FOLDS among the fitted rows, a toxic document kept costing as
#: much as MISS_COST others rejected; the greatest of equal ones. DEFAULT_LIMIT without toxic or without other rows.
LIMITS, DEFAULT_LIMIT, FOLDS, MISS_COST = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5), 0.4, 5, 3
#: How far a site may move a document's log odds: times the difference of the log odds, and at most.
SITE_WEIGHT, SITE_MOST = 0.5, 1.0
TARGETS = ("good", "toxic")
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_TRIM = ".,!?;:\"'()[]{}#*$%&|<>«»¿¡…-_/\\="


def features(text: str) -> set[str]:
    """The words of a text (lower case, trimmed of punctuation, up to 40 characters), the beginnings of the longer ones ('^stem', so that
    rare forms of a known word count too) and buckets of its shape ('=name:bucket')."""
    raw = text.split()
    n = len(raw)
    words = {w.strip(_TRIM)[:40] for w in set(text.lower().split())}
    words.discard("")
    if not n:
        return {"=empty"}
    chars = sum(map(len, raw))
    bucket = lambda x, *steps: sum(x > s for s in steps)
    runs = sum(a == b for a, b in zip(raw, raw[1:], strict=False))
    shape = {
        "words": bucket(n, 10, 20, 40, 100),
        "symbols": bucket(sum(text.count(c) for c in "#*$%&|<>") / n, 0.02, 0.1, 0.3, 1),
        "bars": bucket(text.count("|") / n, 0.02, 0.1, 0.3),
        "shouts": bucket(text.count("!") / n, 0.02, 0.1, 0.3, 1),
        "upper": bucket(len(text.encode("utf-8", "replace").translate(None, _NOT_UPPER)) / chars, 0.05, 0.15, 0.4),
        "runs": bucket(runs / n, 0.02, 0.1, 0.3, 0.6),
        "distinct": bucket(len(set(raw)) / n, 0.1, 0.2, 0.35, 0.5),
        "length": bucket(chars / n, 3, 4, 8, 12),
        "stops": bucket(sum(text.count(c) for c in ".!?") / n, 0.01, 0.03, 0.3),
    }
    stems = {f"^{w[:k]}" for k in STEMS for w in words if len(w) > k}
    return words | stems | {f"={k}:{v}" for k, v in shape.items()}


@dataclass
class Model:
    """weights: feature -> log odds, for each target; bias likewise. limit: the toxicity from which a document is rejected."""

    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {t: {} for t in TARGETS})
    bias: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TARGETS, 0.0))
    limit: float = DEFAULT_LIMIT

    def log_odds(self, found: set[str]) -> list[float]:
        return [self.bias[t] + sum(map(self.weights[t].__getitem__, found & self.weights[t].keys())) for t in TARGETS]


def _fit_one(rows: list[set[str]], y: np.ndarray) -> tuple[dict[str, float], float]:
    n, yes = len(y), float(y.sum())
    prior = np.log((yes + 1) / (n - yes + 1))
    if not yes or yes == n:
        return {}, float(prior)
    among, all_ = Counter(), Counter()
    for found, label in zip(rows, y, strict=True):
        all_.update(found)
        if label:
            among.update(found)
    share = yes / n
    z = {f: (among[f] - c * share) / (c * share * (1 - share) * (1 - c / n) + 1e-9) ** 0.5 for f, c in all_.items() if MIN_DOCS <= c <= n - MIN_DOCS}
    kept = sorted((f for f in z if abs(z[f]) >= MIN_Z), key=lambda f: (-abs(z[f]), f))[:MAX_FEATURES]
    if not kept:
        return {}, float(prior)
    at = {f: i for i, f in enumerate(kept)}
    x = np.zeros((n, len(kept) + 1))
    x[:, -1] = 1
    for i, found in enumerate(rows):
        x[i, [at[f] for f in found & at.keys()]] = 1
    w = np.zeros(len(kept) + 1)
    w[-1] = prior
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-3
    def loss(v: np.ndarray) -> float:
        m = x @ v
        return float((np.logaddexp(0, m) - y * m).sum() + 0.5 * (ridge * v * v).sum())

    now = loss(w)
    for _ in range(20):  # Newton steps on the penalized likelihood, halved until they lower the loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-6:
            step /= 2
        if then > now or np.abs(step).max() < 1e-4:
            break
        w, now = w + step, then
    return {f: float(v) for f, v in zip(kept, w[:-1], strict=True)}, float(w[-1])


def toxic_limit(rows: list[set[str]], y: np.ndarray) -> float:
    """The limit of least cost, each row being judged by a model that the other folds' rows give. rows are in the order of a hash, so folds are random."""
    if not 0 < y.sum() < len(y):
        return DEFAULT_LIMIT
    odds, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        others = np.flatnonzero(fold != k)
        weights, bias = _fit_one([rows[i] for i in others], y[others])
        for i in np.flatnonzero(fold == k):
            odds[i] = bias + sum(weights[f] for f in rows[i] & weights.keys())
    chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    cost = {limit: MISS_COST * ((chance < limit) & (y > 0)).sum() + ((chance >= limit) & (y == 0)).sum() for limit in LIMITS}
    return min(LIMITS, key=lambda limit: (cost[limit], -limit))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """labels (doc_id, quality, toxic); unknown doc_ids and null labels are left out, and of several labels or texts of one doc_id the least counts. Without any labelled row all evidence is 0."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna().groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # one text of each doc_id, chosen before anything is collected: fit_rows rows at most
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "l")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").select("r.text", "r.l.quality", "r.l.toxic").limit(fit_rows).collect()
    model = Model()
    if rows:
        found = [features(r["text"]) for r in rows]
        for t, y in (("good", [r["quality"] > 0 for r in rows]), ("toxic", [r["toxic"] > 0 for r in rows])):
            model.weights[t], model.bias[t] = _fit_one(found, np.array(y, np.float64))
        model.limit = toxic_limit(found, np.array([r["toxic"] > 0 for r in rows], np.float64))
    return model


def scored(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the model's log odds, good and toxic, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [model.log_odds(features(t.as_py())) for t in b["text"]]
            good, toxic = zip(*odds, strict=True) if odds else ((), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], b["path"], pa.array(good, pa.float64()), pa.array(toxic, pa.float64())], names=["doc_id", "host", "path", "good", "toxic"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    return in_arrow(base, run, "doc_id long, host string, path string, good double, toxic double")


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_rates(scores: DataFrame) -> DataFrame:
    """(host, path, good) -> host, path, n, s, prior_a, prior_b, base, host_rate: of each path, its documents' number and expected good
    ones, the Beta prior that its host gives it, the global rate and the host's posterior mean."""
    paths = scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(_chance(F.col("good"))).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def strength(n: str, s: str, mean: Column) -> Column:
        # method of moments: variance between sites over what sampling alone gives, as prior observations from 2 to 1000
        p = F.col(s) / F.col(n)
        noise = mean * (1 - mean)
        between = F.sum(F.col(n) * (p - mean) ** 2 - noise) / F.sum(n)
        return F.greatest(F.lit(2.0), F.least(F.lit(1000.0), F.sum(noise * F.col(n)) / F.sum(n) / F.greatest(between, F.lit(1e-9)) - 1)).alias("k")

    total = hosts.agg((F.sum("hs") / F.sum("hn")).alias("base")).select(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), "base")).alias("base"))
    hosts = hosts.crossJoin(F.broadcast(total))  # one row
    hosts = hosts.crossJoin(F.broadcast(hosts.agg(strength("hn", "hs", F.col("base")))))
    hosts = hosts.select("host", "base", ((F.col("hs") + F.col("k") * F.col("base")) / (F.col("hn") + F.col("k"))).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k = paths.agg(strength("n", "s", F.col("host_rate")))
    return paths.crossJoin(F.broadcast(k)).select("host", "path", "n", "s", "base", "host_rate", (F.col("k") * F.col("host_rate")).alias("prior_a"), (F.col("k") * (1 - F.col("host_rate"))).alias("prior_b"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, host, path, doc_score, host_rate, path_rate, quality, toxicity, kept.

    doc_score is the model's own chance of being good, host_rate and path_rate the posteriors (path_rate without the document itself),
    quality both combined; kept: quality at least 0.5 and toxicity below the model's limit. Empty docs give no rows; repeated rows
    are judged alike. Sites' evidence moves quality alone: toxic documents are few in any site, and a document's own words decide.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    model = fit(docs, labels, fit_rows)
    scores = written(scored(docs, model, col(host), col(path)), "scores")
    joined = scores.join(site_rates(scores), ["host", "path"])
    own = _chance(F.col("good"))
    rate = (F.col("s") - own + F.col("prior_a")) / (F.col("n") - 1 + F.col("prior_a") + F.col("prior_b"))
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate))
    moved = F.greatest(F.lit(-SITE_MOST), F.least(F.lit(SITE_MOST), SITE_WEIGHT * (_odds(rate) - _odds(F.col("base")))))
    out = joined.select("doc_id", "host", "path", own.alias("doc_score"), "host_rate", rate.alias("path_rate"), _chance(F.col("good") + moved).alias("quality"), _chance(F.col("toxic")).alias("toxicity"))
    return out.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxicity") < model.limit))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The kept rows of docs, columns unchanged. Rows with a null doc_id can't be named and stay; if one of several rows of a doc_id is rejected, all are."""
    return without(docs, written(classify(docs, labels, host, path, fit_rows).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id"), "rejected"))
