"""Minute, hour and day rollups: building, merging, replacing, rebuilding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import GRAINS

KEYS = ["window_start", "region", "event_type"]
REVENUE = "decimal(24,4)"


def window_start(grain: str, ts: str = "ts") -> Column:
    """Start of the minute, hour or day, of the type of ``ts`` where that has no zone."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain!r}")
    return F.date_trunc(grain, F.col(ts))


def _sums(events: Column) -> list[Column]:
    return [events.cast("bigint").alias("events"), F.coalesce(F.sum("revenue"), F.lit(0)).cast(REVENUE).alias("revenue")]


def rollup(events: DataFrame, grain: str) -> DataFrame:
    """Events and revenue by window, region and type. Tasks sum before the shuffle, so a busy key is no hot one."""
    return events.groupBy(window_start(grain).alias("window_start"), "region", "event_type").agg(*_sums(F.count("*")))


def coarsen(finer: DataFrame, grain: str) -> DataFrame:
    """A coarser rollup from a finer one: sums of sums."""
    return finer.groupBy(window_start(grain, "window_start").alias("window_start"), "region", "event_type").agg(*_sums(F.sum("events")))


def merge_delta(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert: counts and revenue of equal keys add up. Only for true deltas, each applied once."""
    return existing.select(*KEYS, "events", "revenue").unionByName(delta.select(*KEYS, "events", "revenue")).groupBy(*KEYS).agg(*_sums(F.sum("events")))


def replace_by_key(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """Idempotent upsert: rows of ``changed`` stand for those of equal key. Right for totals, and when replayed."""
    columns = [*KEYS, "events", "revenue"]
    return existing.select(*columns).join(changed.select(*KEYS), KEYS, "left_anti").unionByName(changed.select(*columns))


def rebuild(events: DataFrame, path: str, grain: str) -> None:
    """Overwrite the days that ``events`` touches and leave the others."""
    rolled = rollup(events, grain).withColumn("date", F.to_date("window_start"))
    rolled.repartition("date").sortWithinPartitions("window_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
