"""Aggregates over raw events and summaries, lookups, counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import GROUPABLE, ROLLUP_DIMENSIONS
from tidemark.operators.rollups import REVENUE


def _dimension(group_by: str, allowed: tuple[str, ...]) -> Column:
    if group_by not in allowed:
        raise ValueError(f"cannot group by {group_by!r}; use one of {', '.join(allowed)}")
    return F.col(group_by).cast("string").alias("dim")


def filtered(df: DataFrame, region: str | None = None, event_type: str | None = None) -> DataFrame:
    """Optional equality filters; an empty string is no filter."""
    for name, value in (("region", region), ("event_type", event_type)):
        if value:
            df = df.where(F.col(name) == value)
    return df


def closed_range(df: DataFrame, start, end, column: str = "ts") -> DataFrame:
    """``start <= column <= end``; pushed down to the scan."""
    return df.where(F.col(column).between(F.lit(start).cast(df.schema[column].dataType), F.lit(end).cast(df.schema[column].dataType)))


def half_open_range(df: DataFrame, start, end, column: str = "ts") -> DataFrame:
    """``start <= column < end``."""
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(end).cast(kind)))


def _totals(events: Column) -> list[Column]:
    return [F.coalesce(events, F.lit(0)).cast("bigint").alias("events"), F.coalesce(F.sum("revenue"), F.lit(0)).cast(REVENUE).alias("revenue")]


def raw_aggregate(events: DataFrame, start, end, group_by: str = "region", region: str | None = None, event_type: str | None = None) -> DataFrame:
    """(dim, events, revenue) of the raw events of a closed time range."""
    dim = _dimension(group_by, GROUPABLE)
    return filtered(closed_range(events, start, end), region, event_type).groupBy(dim).agg(*_totals(F.count("*")))


def summary_aggregate(summary: DataFrame, start, end, group_by: str = "region", region: str | None = None, event_type: str | None = None) -> DataFrame:
    """The same from a rollup: windows whose start lies in the closed range."""
    dim = _dimension(group_by, ROLLUP_DIMENSIONS)
    return filtered(closed_range(summary, start, end, "window_start"), region, event_type).groupBy(dim).agg(*_totals(F.sum("events")))


def exact_aggregate(events: DataFrame, summary: DataFrame, start: datetime, end: datetime, group_by: str = "region", region: str | None = None, event_type: str | None = None) -> DataFrame:
    """The raw answer at nearly the summary's cost: whole hours inside the range from the summary, the edges from raw events."""
    dim = _dimension(group_by, ROLLUP_DIMENSIONS)
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    first = floor(start) if floor(start) == start else floor(start) + timedelta(hours=1)
    last = floor(end)  # whole hours are [first, last)
    if first >= last:
        return raw_aggregate(events, start, end, group_by, region, event_type)
    whole = half_open_range(summary, first, last, "window_start").select("region", "event_type", "events", "revenue")
    edges = half_open_range(events, start, first).unionByName(closed_range(events, last, end))
    edges = edges.select("region", "event_type", F.lit(1).cast("bigint").alias("events"), F.col("revenue").cast(REVENUE).alias("revenue"))
    return filtered(whole.unionByName(edges), region, event_type).groupBy(dim).agg(*_totals(F.sum("events")))


def user_events(events: DataFrame, user_id: str, limit: int = 50) -> DataFrame:
    """A user's latest events; ties by id. A filter and a top-k, no full sort."""
    return events.where(F.col("user_id") == user_id).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def sample_user(events: DataFrame) -> str | None:
    """Some user, always the same; None for an empty table."""
    return events.agg(F.min("user_id").alias("user_id")).first()["user_id"]


def latest_insights(insights: DataFrame, limit: int = 100) -> DataFrame:
    return insights.orderBy(F.desc("window_start"), "kind", "entity").limit(min(limit, 100))


def top_region(summary: DataFrame) -> DataFrame:
    """The region of most revenue; ties by name."""
    return summary.groupBy("region").agg(*_totals(F.sum("events"))).orderBy(F.desc("revenue"), "region").limit(1)


def refund_rate(events: DataFrame) -> DataFrame:
    """One row: purchases, refunds and their ratio, null without purchases."""
    kinds = events.agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "refund").alias("refunds"))
    return kinds.withColumn("refund_rate", F.round(F.expr("try_divide(refunds, purchases)"), 6))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def order_by_revenue(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("revenue"), "dim")
