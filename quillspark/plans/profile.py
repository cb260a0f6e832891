"""Timing and I/O of queries: one, or many at once on a thread pool over one session."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Profile:
    """elapsed_ns is 1 at least; rows is what the query returned, files and read_bytes what its scans read. All are filled also if the query fails, rows then with 0."""

    elapsed_ns: int = 0
    rows: int = 0
    files: int = 0
    read_bytes: int = 0
    _began: int = field(default=0, repr=False)

    def __enter__(self) -> Profile:
        self._began = time.perf_counter_ns()
        return self

    def __exit__(self, *_) -> None:
        self.elapsed_ns = max(1, time.perf_counter_ns() - self._began)


def _scanned(plan) -> tuple[int, int]:
    """(files, bytes) of the file scans in a physical plan, adaptive stages included."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _scanned(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _scanned(plan.plan())
    metrics, found = plan.metrics(), [0, 0]
    if kind.startswith("FileSourceScan"):
        for i, name in enumerate(("numFiles", "filesSize")):
            found[i] += metrics.apply(name).value() if metrics.contains(name) else 0
    children = plan.children()
    for i in range(children.size()):
        files, size = _scanned(children.apply(i))
        found[0] += files
        found[1] += size
    return found[0], found[1]


def run(df: DataFrame, sink: Callable[[DataFrame], object] = DataFrame.collect, profile: Profile | None = None) -> tuple[object, Profile]:
    """(what the sink returns, profile). An error of the query or the sink is raised, after the profile that was given is filled. Files and bytes are those of what the sink collects itself."""
    seen, p = Observation(), profile or Profile()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    try:
        with p:
            out = sink(observed)
        p.rows = seen.get["rows"]
    finally:
        p.files, p.read_bytes = _scanned(observed._jdf.queryExecution().executedPlan())
    return out, p


def percentile(values: list[float], q: float) -> float:
    """Nearest rank."""
    ordered = sorted(values)
    return ordered[max(0, -(-int(q * len(ordered)) // 100) - 1)] if ordered else 0.0


def throughput(queries: list[Callable[[], DataFrame]], threads: int = 4, warm_up: int = 1) -> dict[str, float]:
    """Runs all queries warm_up times uncounted, then once each on the threads: queries a second and p50, p90, p99 in milliseconds."""

    def one(q: Callable[[], DataFrame]) -> float:
        with Profile() as p:
            q().collect()
        return p.elapsed_ns / 1e6

    with ThreadPoolExecutor(threads) as pool:
        for _ in range(warm_up):
            list(pool.map(one, queries))
        began = time.perf_counter()
        ms = list(pool.map(one, queries))
        seconds = time.perf_counter() - began
    return {"qps": len(ms) / seconds, "p50_ms": percentile(ms, 50), "p90_ms": percentile(ms, 90), "p99_ms": percentile(ms, 99)}
