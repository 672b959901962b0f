"""Validation, enrichment, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.constants import DROP_REASONS, REGION_FX
from tidemark.functions import events as E
from tidemark.schemas import EVENT_COLUMNS


def classify(raw: DataFrame) -> DataFrame:
    """``raw`` with ``reason``: the first rule that a row breaks, or null."""
    return raw.withColumn("reason", E.drop_reason())


def enrich(valid: DataFrame) -> DataFrame:
    """The twelve event columns of valid rows. Works on streams."""
    made = valid.withColumns(
        {"revenue": E.revenue(), "hour": E.hour_of_day(), "day_of_week": E.day_of_week(), "amount_band": E.amount_band(), "amount": E.normal_amount()}
    )
    return made.select(*EVENT_COLUMNS)


def transform(raw: DataFrame) -> DataFrame:
    """Valid rows only, enriched: a filter and a projection in one codegen span."""
    return enrich(raw.where(E.drop_reason().isNull()))


def observed_transform(raw: DataFrame, name: str = "drops") -> tuple[DataFrame, Observation | str]:
    """As ``transform``, counting rows and drops by reason on the way, without a pass of its own.

    Of a stream, the counts of each micro-batch are in its progress under the name, for ``metrics.ProgressLog``.
    """
    seen = name if raw.isStreaming else Observation(name)
    counts = [F.count(F.lit(1)).alias("events_in"), *(F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in DROP_REASONS)]
    marked = classify(raw).observe(seen, *counts)
    return enrich(marked.where("reason is null")), seen


def drop_counts(raw: DataFrame) -> DataFrame:
    """(reason, n) with valid rows under ``valid``."""
    return classify(raw).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def dedupe(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each ``event_id``, the earliest (then the least by user); ids that ``existing`` has are left out."""
    first = Window.partitionBy("event_id").orderBy("ts", "user_id")
    out = events.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    if existing is not None:
        out = out.join(existing.select("event_id"), "event_id", "left_anti")
    return out


def dedupe_stream(events: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """One row for each ``event_id`` within the watermark; state goes as the watermark passes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def fx_table(spark) -> DataFrame:
    """The exchange rates as a table of five rows."""
    return spark.createDataFrame(list(REGION_FX.items()), "region string, rate string").select("region", F.col("rate").cast("decimal(3,2)").alias("rate"))


def enrich_by_join(raw: DataFrame) -> DataFrame:
    """As ``transform``, with the rates from a joined table; five rows, so a broadcast."""
    valid = raw.where(E.drop_reason().isNull()).join(F.broadcast(fx_table(raw.sparkSession)), "region")
    made = valid.withColumns({"revenue": E.revenue(F.col("rate")), "hour": E.hour_of_day(), "day_of_week": E.day_of_week(), "amount_band": E.amount_band(), "amount": E.normal_amount()})
    return made.select(*EVENT_COLUMNS)
