"""Detectors on a stream of closed windows: the batch expressions over a bounded stretch of history.

Each micro-batch of closed windows is written beside the earlier ones, and the four detectors of ``operators.insights`` run over the
windows of the batch and as much history as their frames reach back to. Only insights of the batch's own windows are kept, then the
cooldown is applied behind those emitted before. So there is one definition of each detector, for batch and stream, and all state
lies in the store: a restart goes on where it stopped, a replayed batch finds its insights there.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import insights
from tidemark.settings import Detection
from tidemark.sources.store import Store

#: How far back the last rows of a region are looked for.
LOOKBACK = timedelta(days=2)


def with_history(windows: DataFrame, first, detection: Detection = Detection()) -> DataFrame:
    """Rows of ``windows`` from ``first`` on, and before it as many windows of each region as the frames of the detectors reach back."""
    reach = max(detection.baseline_windows, detection.trend_least) + 1
    early = windows.where(F.col("window_start") < first)
    rank = F.dense_rank().over(Window.partitionBy("region").orderBy(F.desc("window_start")))
    # The last window of all counts for the shares of the next one, whatever regions it has.
    last = early.agg(F.max("window_start")).scalar()
    kept = early.withColumn("_rank", rank).where((F.col("_rank") <= reach) | (F.col("window_start") == last)).drop("_rank")
    return kept.unionByName(windows.where(F.col("window_start") >= first))


def detect_new(windows: DataFrame, emitted: DataFrame, first, detection: Detection = Detection()) -> DataFrame:
    """Insights of the ``windows`` from ``first`` on that the cooldown lets through behind those ``emitted`` before."""
    found = insights.detect(with_history(windows, first, detection), detection, cool=False).where(F.col("window_start") >= first)
    gap = timedelta(seconds=detection.cooldown_seconds)
    before = emitted.where((F.col("window_start") < first) & (F.col("window_start") >= first - gap)).select(*found.columns)
    return insights.cooldown(before.unionByName(found), detection.cooldown_seconds, detection.cooldown_strict).where(F.col("window_start") >= first)


def detect_sink(store: Store, detection: Detection = Detection(), name: str = "aggregates_1m", lookback: timedelta = LOOKBACK) -> Callable[[DataFrame, int], None]:
    """A sink for append-mode rollups: windows go to the table ``name`` of the store, what they set off to its insights."""

    def write(batch: DataFrame, batch_id: int) -> None:
        first = batch.agg(F.min("window_start")).first()[0]
        if first is None:
            return
        store.replace(name, batch)
        since = F.to_date(F.lit(first - lookback))
        windows = store.read(name).where(F.col("date") >= since).drop("date")
        emitted = store.read("insights").where(F.col("date") >= since)
        store.insert_insights(detect_new(windows, emitted, first, detection).checkpoint())

    return write
