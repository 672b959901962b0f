"""The hot layer: the newest active minute windows.

As expressions over a rollup of any size, and as ``HotTable``: those windows alone, a few thousand rows of Arrow on the driver,
kept up by the batches of a stream, so that recent aggregates start no Spark job.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import ROLLUP_DIMENSIONS
from tidemark.operators.aggregates import filtered
from tidemark.operators.rollups import KEYS, REVENUE
from tidemark.settings import Serving


def _check(group_by: str) -> None:
    if group_by not in ROLLUP_DIMENSIONS:
        raise ValueError(f"the hot layer cannot group by {group_by!r}")


def newest_windows(minutes: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` newest windows that have any; all for 0.

    The distinct starts are found by a top-k, which each task cuts to ``n`` rows, and joined back.
    """
    if not n:
        return minutes
    starts = minutes.select("window_start").distinct().orderBy(F.desc("window_start")).limit(n)
    return minutes.join(starts, "window_start", "left_semi")


def recent_aggregate(minutes: DataFrame, n: int = 60, region: str | None = None, event_type: str | None = None, group_by: str = "region") -> DataFrame:
    """(dim, events, revenue) over the newest windows, largest revenue first. Other dimensions than the rollup's are an error."""
    _check(group_by)
    rows = filtered(newest_windows(minutes, n), region, event_type)
    sums = rows.groupBy(F.col(group_by).alias("dim")).agg(F.sum("events").cast("bigint").alias("events"), F.sum("revenue").cast(REVENUE).alias("revenue"))
    return sums.orderBy(F.desc("revenue"), "dim")


def recent_totals(minutes: DataFrame, n: int = 60, region: str | None = None, event_type: str | None = None) -> DataFrame:
    """One row: events, revenue and the number of windows looked at, before the filters."""
    rows = newest_windows(minutes, n)
    keep = F.lit(True)
    for name, value in (("region", region), ("event_type", event_type)):
        if value:
            keep &= F.col(name) == value
    return rows.agg(
        F.coalesce(F.sum(F.when(keep, F.col("events"))), F.lit(0)).cast("bigint").alias("events"),
        F.coalesce(F.sum(F.when(keep, F.col("revenue"))), F.lit(0)).cast(REVENUE).alias("revenue"),
        F.count_distinct("window_start").alias("windows"),
    )


def last_window(minutes: DataFrame) -> DataFrame:
    """The rows of the newest window."""
    return newest_windows(minutes, 1)


class HotTable:
    """The newest ``hot_minutes`` windows of a minute rollup, a row for each region and type.

    ``feed`` takes totals of windows, which stand for those of equal key, or deltas, which add up; windows beyond the newest go.
    Only windows that can stay are collected, so neither a backlog nor a long table comes to the driver.
    """

    SCHEMA = pa.schema([("window_start", pa.timestamp("us", "UTC")), ("region", pa.string()), ("event_type", pa.string()), ("events", pa.int64()), ("revenue", pa.decimal128(24, 4))])

    def __init__(self, serving: Serving = Serving()):
        self.size = serving.hot_minutes
        self.rows = self.SCHEMA.empty_table()

    def _collected(self, df: DataFrame) -> pa.Table:
        found = newest_windows(df.select(*KEYS, "events", F.col("revenue").cast(REVENUE).alias("revenue")), self.size).toArrow()
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(found.columns, self.SCHEMA)], schema=self.SCHEMA)

    def feed(self, df: DataFrame, delta: bool = False) -> HotTable:
        new = self._collected(df)
        if delta:
            both = pa.concat_tables([self.rows, new]).group_by(KEYS).aggregate([("events", "sum"), ("revenue", "sum")])
            both = pa.Table.from_arrays([both.column(n).cast(f.type) for n, f in zip([*KEYS, "events_sum", "revenue_sum"], self.SCHEMA)], schema=self.SCHEMA)
        else:
            both = pa.concat_tables([self.rows.join(new.select(KEYS), KEYS, join_type="left anti"), new])
        self.rows = self._newest(both, self.size).combine_chunks()
        return self

    @staticmethod
    def _newest(rows: pa.Table, n: int) -> pa.Table:
        starts = pc.unique(rows.column("window_start"))
        if not n or len(starts) <= n:
            return rows
        least = starts.take(pc.sort_indices(starts, sort_keys=[("", "descending")]))[n - 1]
        return rows.filter(pc.greater_equal(rows.column("window_start"), least))

    def _looked_at(self, n: int, region: str | None, event_type: str | None) -> tuple[pa.Table, int]:
        rows = self._newest(self.rows, n)
        windows = len(pc.unique(rows.column("window_start")))
        for name, value in (("region", region), ("event_type", event_type)):
            if value:
                rows = rows.filter(pc.equal(rows.column(name), value))
        return rows, windows

    def aggregate(self, n: int = 60, region: str | None = None, event_type: str | None = None, group_by: str = "region") -> list[dict]:
        """As ``recent_aggregate``."""
        _check(group_by)
        rows, _ = self._looked_at(n, region, event_type)
        sums = rows.group_by(group_by).aggregate([("events", "sum"), ("revenue", "sum")]).sort_by([("revenue_sum", "descending"), (group_by, "ascending")])
        return [{"dim": r[group_by], "events": r["events_sum"], "revenue": r["revenue_sum"]} for r in sums.to_pylist()]

    def totals(self, n: int = 60, region: str | None = None, event_type: str | None = None) -> dict:
        """As ``recent_totals``."""
        rows, windows = self._looked_at(n, region, event_type)
        return {"events": pc.sum(rows.column("events")).as_py() or 0, "revenue": pc.sum(rows.column("revenue")).as_py() or Decimal("0.0000"), "windows": windows}

    def last_window(self) -> list[dict]:
        return self._newest(self.rows, 1).to_pylist()
