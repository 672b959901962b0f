"""Synthetic events whose every field is a hash of seed and row number: the same in any partitioning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import AMOUNT_MU, AMOUNT_SIGMA, DEVICES, MONETARY, REGIONS, TYPE_WEIGHTS, USERS

START = datetime(2024, 1, 1)


def _uniform(row: Column, seed: int, what: str) -> Column:
    """A number in (0, 1)."""
    return (F.pmod(F.xxhash64(row, F.lit(seed), F.lit(what)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _choice(u: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def _fields(row: Column, seed: int, ts: Column) -> list[Column]:
    u, below, kind = _uniform(row, seed, "type"), 0.0, None
    for name, weight in TYPE_WEIGHTS.items():
        below += weight
        kind = F.when(u < below, name) if kind is None else kind.when(u < below, name)
    kind = kind.otherwise(list(TYPE_WEIGHTS)[-1])
    # A normal deviate from two uniform ones.
    normal = F.sqrt(-2 * F.log(_uniform(row, seed, "radius"))) * F.cos(2 * F.pi() * _uniform(row, seed, "angle"))
    amount = F.exp(AMOUNT_MU + AMOUNT_SIGMA * normal).cast("decimal(12,2)")
    return [
        F.md5(F.concat_ws("/", F.lit(str(seed)), row.cast("string"))).alias("event_id"),
        ts.alias("ts"),
        F.format_string("u%05d", F.floor(_uniform(row, seed, "user") * USERS)).alias("user_id"),
        F.substring(F.sha1(F.concat_ws("/", F.lit(str(seed)), row.cast("string"))), 1, 8).alias("session_id"),
        kind.alias("event_type"),
        _choice(_uniform(row, seed, "region"), REGIONS).alias("region"),
        _choice(_uniform(row, seed, "device"), DEVICES).alias("device"),
        F.when(kind.isin(*MONETARY), amount).alias("amount"),
        F.lit(0).cast("bigint").alias("created_ns"),
    ]


def bulk(spark: SparkSession, n: int, seed: int = 42, start: datetime = START, spread_seconds: int = 86_400, partitions: int | None = None, ordered: bool = True) -> DataFrame:
    """``n`` events spread evenly over the time from ``start``, in order of time if asked for."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    row = F.col("id")
    ts = F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.floor(_uniform(row, seed, "ts") * spread_seconds * 1_000_000)).cast("bigint"))
    out = rows.select(*_fields(row, seed, ts))
    return out.orderBy("ts", "event_id") if ordered else out


def paced(spark: SparkSession, eps: int, seed: int = 42, burst_every: int = 15, burst_duration: int = 5, burst_multiplier: int = 4, time_scale: float = 1.0, start: datetime = START) -> DataFrame:
    """A stream of about ``eps`` events a second, more in bursts; event time runs ``time_scale`` times as fast as the clock.

    The rate source gives the peak rate, and outside bursts all but one in ``burst_multiplier`` rows are left out.
    """
    rate = spark.readStream.format("rate").option("rowsPerSecond", eps * burst_multiplier).load()
    return paced_rows(rate, eps, seed, burst_every, burst_duration, burst_multiplier, time_scale, start)


def paced_rows(rate: DataFrame, eps: int, seed: int = 42, burst_every: int = 15, burst_duration: int = 5, burst_multiplier: int = 4, time_scale: float = 1.0, start: datetime = START) -> DataFrame:
    """Events for the rows (timestamp, value) of a source of ``eps * burst_multiplier`` rows a second."""
    second = F.floor(F.col("value") / (eps * burst_multiplier))
    in_burst = (burst_every > 0) & (second % max(burst_every + burst_duration, 1) >= burst_every) if burst_every else F.lit(False)
    kept = rate.where(in_burst | (F.col("value") % burst_multiplier == 0))
    passed = F.col("value").cast("double") / (eps * burst_multiplier) * time_scale
    ts = F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.floor(passed * 1_000_000)).cast("bigint"))
    created = (F.unix_micros("timestamp") * 1000).alias("created_ns")
    return kept.select(*[c for c in _fields(F.col("value"), seed, ts)][:-1], created)
