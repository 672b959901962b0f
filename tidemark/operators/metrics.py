"""Latency statistics over tables, and what running queries and answered requests tell."""

from __future__ import annotations

import time
from collections import Counter, defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window

PERCENTILES = (50, 95, 99)
#: Ranges of values that are ranked apart.
RANGES = 64


def nearest_rank(values: list[float], p: float) -> float:
    """The value at ``round(p / 100 * (n - 1))`` of the sorted list; 0 for an empty one."""
    return sorted(values)[round(p / 100 * (len(values) - 1))] if values else 0.0


def latency_percentiles(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, max and the exact nearest-rank percentiles.

    Ranks come from counts of distinct values, whose running total is taken within ranges and then over the ranges, so that
    no task sorts the whole column. Ranges lie between approximate quantiles, so they hold about as many values each, however the values lie.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    cuts = values.agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 1000)).scalar()
    values = values.withColumn("cuts", cuts).select("x", "n", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("part"))
    sums = values.groupBy("part").agg(F.sum("n").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("before"), F.sum("total").over(every).alias("all"))
    ranked = values.join(sums, "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x")))
    at = lambda p: F.min(F.when(F.col("upto") > F.rint(F.lit(p) / 100 * (F.col("all") - 1)), F.col("x"))).alias(f"p{p}")
    mean = F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6)
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean.alias("mean"), F.max("x").alias("max"), *(at(p) for p in PERCENTILES))


def described(values: list[float]) -> dict[str, float]:
    """Count, mean, largest and percentiles of some samples; zeros for none."""
    out = {"count": len(values), "mean": float(np.mean(values)) if values else 0.0, "max": max(values, default=0.0)}
    return out | {f"p{p}": nearest_rank(values, p) for p in PERCENTILES}


class ProgressLog(StreamingQueryListener):
    """The last progress reports of the queries of a session, and totals of all.

    Rows in and drops by reason are the engine's own observations (``observed_transform``), so nothing is counted twice or on the side.
    """

    def __init__(self, keep: int = 20_000):
        self.totals: Counter[str] = Counter()
        self.reports: deque[dict[str, float]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        self.totals["queries_started"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.append({"rows": int(p.numInputRows), "rows_per_second": float(p.processedRowsPerSecond or 0.0), "batch_ms": float(p.batchDuration or 0)})
        self.totals["rows"] += int(p.numInputRows)
        for seen in (p.observedMetrics or {}).values():
            self.totals.update({name: int(n or 0) for name, n in seen.asDict().items() if isinstance(n, int)})

    def onQueryIdle(self, event) -> None:
        self.totals["idle"] += 1

    def onQueryTerminated(self, event) -> None:
        self.totals["queries_ended"] += 1

    def summary(self) -> dict:
        return {"totals": dict(self.totals), **{name: described([r[name] for r in self.reports]) for name in ("rows_per_second", "batch_ms")}}


class RequestLog:
    """Which kind of request was answered by which backend, how often, and how long the last ones took."""

    def __init__(self, keep: int = 20_000):
        self.answered: Counter[tuple[str, str]] = Counter()
        self.times: dict[str, deque[float]] = defaultdict(lambda: deque(maxlen=keep))

    def add(self, kind: str, backend: str, began: float) -> float:
        """Note an answer that started at ``began`` (of ``time.perf_counter``); returns the milliseconds it took."""
        took = round((time.perf_counter() - began) * 1000, 3)
        self.answered[kind, backend] += 1
        self.times[backend].append(took)
        return took

    def summary(self) -> dict:
        return {"answered": {f"{kind} by {backend}": n for (kind, backend), n in self.answered.items()}, "ms": {b: described(list(t)) for b, t in self.times.items()}}
