"""The nightly rebuild and its report."""

from __future__ import annotations

import argparse
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rollups
from tidemark.operators.aggregates import half_open_range
from tidemark.settings import load
from tidemark.sources.store import JdbcStore, Store


def summarize(events: DataFrame, start, end) -> DataFrame:
    """The hourly rollup of ``start <= ts < end``."""
    return rollups.rollup(half_open_range(events, start, end), "hour")


def report(summary: DataFrame) -> DataFrame:
    """One row from one pass over the summary: events, top region and its revenue, refund rate."""
    kind = lambda name: F.sum(F.when(F.col("event_type") == name, F.col("events")).otherwise(0))
    by_region = summary.groupBy("region").agg(F.sum("events").alias("events"), F.sum("revenue").alias("revenue"), kind("purchase").alias("purchases"), kind("refund").alias("refunds"))
    best = F.max(F.struct("revenue", "region"))
    return by_region.agg(
        F.sum("events").cast("bigint").alias("events"), best["region"].alias("top_region"), best["revenue"].cast(rollups.REVENUE).alias("top_revenue"),
        F.sum("purchases").cast("bigint").alias("purchases"), F.sum("refunds").cast("bigint").alias("refunds"),
    ).withColumn("refund_rate", F.round(F.expr("try_divide(refunds, purchases)"), 6))


def whole_hours(start: datetime | str, end: datetime | str) -> tuple[datetime, datetime]:
    """The hours that a range touches: from the start of its first to the end of its last."""
    start, end = (datetime.fromisoformat(t) if isinstance(t, str) else t for t in (start, end))
    last = end.replace(minute=0, second=0, microsecond=0)
    return start.replace(minute=0, second=0, microsecond=0), last if last == end else last + timedelta(hours=1)


def rebuild(store: Store, start: datetime | str, end: datetime | str) -> DataFrame:
    """Compute the hours that the range touches anew from events, leave all others as they are, and return the report of these hours."""
    first, last = whole_hours(start, end)
    days = store.read("events").where(F.col("date").between(F.lit(first.date()), F.lit(last.date())))
    store.replace_range("summary_hourly", summarize(days, first, last), first, last)
    return report(half_open_range(store.read("summary_hourly"), first, last, "window_start"))


def main(args: list[str] | None = None) -> None:
    """Rebuild from the warehouse, or from a database into it or into another table there."""
    storage = load().storage
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--warehouse", default=storage.warehouse)
    p.add_argument("--jdbc-url", default=storage.jdbc_url, help="read events from this database, a task for each hour, and write the summary there")
    p.add_argument("--start", required=True, help="first instant, inclusive")
    p.add_argument("--end", required=True, help="last instant, exclusive")
    p.add_argument("--partitions", type=int, default=16)
    a = p.parse_args(args)
    from tidemark.session import session

    spark: SparkSession = session("tidemark-batch", partitions=a.partitions)
    if a.jdbc_url:
        between_databases(JdbcStore(spark, a.jdbc_url), a.start, a.end, a.partitions).show(truncate=False)
    else:
        rebuild(Store(spark, a.warehouse), a.start, a.end).show(truncate=False)


def between_databases(store: JdbcStore, start: datetime | str, end: datetime | str, partitions: int = 16) -> DataFrame:
    """Scan the events of the range in parallel, write their hourly summary over the one there, and return the report."""
    first, last = whole_hours(start, end)
    bounds = [first + (last - first) * i / partitions for i in range(partitions + 1)]
    summary = summarize(store.read("events", bounds), first, last)
    store.write(summary, "summary_hourly", "overwrite")
    return report(store.read("summary_hourly"))


if __name__ == "__main__":
    main()
