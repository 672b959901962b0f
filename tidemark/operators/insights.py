"""Detectors over closed windows as native window expressions.

Input is a rollup of any grain. Windows without rows of a region do not exist for it, so frames count rows, not time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.constants import REGIONS
from tidemark.settings import Detection

COLUMNS = ["window_start", "kind", "severity", "entity", "metric", "value", "baseline", "message"]
DEFAULTS = Detection()


def region_revenue(rollup: DataFrame) -> DataFrame:
    """(window_start, region, v): revenue of each region in each window it has rows in."""
    return rollup.groupBy("window_start", "region").agg(F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("v"))


def anomalies(rollup: DataFrame, config: Detection = DEFAULTS) -> DataFrame:
    """Revenue far from the mean of the region's previous windows, in floored population standard deviations."""
    before = Window.partitionBy("region").orderBy("window_start").rowsBetween(-config.baseline_windows, -1)
    rows = region_revenue(rollup).select("window_start", "region", "v", F.count("v").over(before).alias("n"), F.avg("v").over(before).alias("mean"), F.stddev_pop("v").over(before).alias("std"))
    floor = F.greatest(F.col("std"), F.abs("mean") * 0.01, F.lit(1e-6))
    rows = rows.where(F.col("n") >= config.baseline_least).withColumn("z", (F.col("v") - F.col("mean")) / floor)
    rows = rows.where(F.abs("z") >= config.z_warning)
    side = F.when(F.col("z") > 0, "above").otherwise("below")
    return rows.select(
        "window_start",
        F.when(F.col("z") > 0, "anomaly_spike").otherwise("anomaly_drop").alias("kind"),
        F.when(F.abs("z") >= config.z_critical, "critical").otherwise("warning").alias("severity"),
        F.col("region").alias("entity"),
        F.lit("revenue").alias("metric"),
        F.round("v", 2).alias("value"),
        F.round("mean", 2).alias("baseline"),
        F.format_string("revenue of %s stands %.1f deviations %s its mean (%.2f, mean %.2f)", F.col("region"), F.abs("z"), side, F.col("v"), F.col("mean")).alias("message"),
    )


def trends(rollup: DataFrame, config: Detection = DEFAULTS) -> DataFrame:
    """A steady rise or fall: the fitted slope over the frame, times its length, against the mean."""
    order = Window.partitionBy("region").orderBy("window_start")
    upto = order.rowsBetween(-(config.baseline_windows - 1), 0)
    rows = region_revenue(rollup).withColumn("i", F.row_number().over(order).cast("double"))
    rows = rows.select("window_start", "region", "v", F.count("v").over(upto).alias("n"), F.avg("v").over(upto).alias("mean"), F.regr_slope("v", "i").over(upto).alias("slope"))
    rows = rows.where(F.col("n") >= config.trend_least).withColumn("mean", F.when(F.col("mean") == 0, F.lit(1.0)).otherwise(F.col("mean")))
    rows = rows.withColumn("norm", F.col("slope") * F.col("n") / F.abs("mean")).where(F.abs("norm") >= config.trend_share)
    rises = F.col("norm") > 0
    return rows.select(
        "window_start",
        F.when(rises, "trend_up").otherwise("trend_down").alias("kind"),
        F.lit("info").alias("severity"),
        F.col("region").alias("entity"),
        F.lit("revenue").alias("metric"),
        F.round("v", 2).alias("value"),
        F.round("mean", 2).alias("baseline"),
        F.format_string("revenue of %s is %s: %+.0f%% over %d windows", F.col("region"), F.when(rises, "rising").otherwise("falling"), F.col("norm") * 100, F.col("n")).alias("message"),
    )


def refund_rates(rollup: DataFrame, config: Detection = DEFAULTS) -> DataFrame:
    """Windows of enough purchases whose refunds exceed the share."""
    kind = lambda name: F.sum(F.when(F.col("event_type") == name, F.col("events")).otherwise(0))
    rows = rollup.groupBy("window_start").agg(kind("purchase").alias("purchases"), kind("refund").alias("refunds"))
    rows = rows.where(F.col("purchases") >= config.refund_purchases).withColumn("rate", F.col("refunds") / F.col("purchases"))
    rows = rows.where(F.col("rate") > config.refund_rate)
    return rows.select(
        "window_start",
        F.lit("threshold").alias("kind"),
        F.lit("warning").alias("severity"),
        F.lit("refund_rate").alias("entity"),
        F.lit("refund_rate").alias("metric"),
        F.round("rate", 4).alias("value"),
        F.lit(config.refund_rate).alias("baseline"),
        F.format_string("%d refunds for %d purchases: %.1f%%, over the limit of %.0f%%", F.col("refunds"), F.col("purchases"), F.col("rate") * 100, F.lit(config.refund_rate * 100)).alias("message"),
    )


def region_rank(region: Column) -> Column:
    """Place of a region in the canonical order; others come last."""
    out = F.lit(len(REGIONS))
    for i, name in enumerate(REGIONS):
        out = F.when(region == name, F.lit(i)).otherwise(out)
    return out


def top_movers(rollup: DataFrame, config: Detection = DEFAULTS) -> DataFrame:
    """The first region, in canonical order, whose share of revenue moved since the window before.

    A window of no positive total breaks the chain: it emits nothing, and nor does its successor. A window is one row with the revenue of
    its regions by then, so the order over all of them is taken after aggregation.
    """
    order = Window.orderBy("window_start")
    shares = F.map_from_entries(F.collect_list(F.struct("region", "v")))  # a few regions
    windows = region_revenue(rollup).groupBy("window_start").agg(F.sum("v").alias("total"), shares.alias("now"))
    windows = windows.select("window_start", "total", "now", F.lag("total").over(order).alias("last_total"), F.lag("now").over(order).alias("last")).where("total > 0 and last_total > 0")
    moved = windows.select("window_start", "total", "last_total", "last", F.explode("now").alias("region", "v"))
    was = F.coalesce(F.try_element_at("last", F.col("region")) / F.col("last_total"), F.lit(0.0))
    moved = moved.select("window_start", "region", (F.col("v") / F.col("total")).alias("share"), was.alias("was")).where(F.abs(F.col("share") - F.col("was")) >= config.mover_share)
    first = moved.groupBy("window_start").agg(F.min_by(F.struct("region", "share", "was"), region_rank(F.col("region"))).alias("m")).select("window_start", "m.*")
    return first.select(
        "window_start",
        F.lit("top_mover").alias("kind"),
        F.lit("info").alias("severity"),
        F.col("region").alias("entity"),
        F.lit("revenue_share").alias("metric"),
        F.round("share", 4).alias("value"),
        F.round("was", 4).alias("baseline"),
        F.format_string("%s %s revenue share: %.1f%% after %.1f%%", F.col("region"), F.when(F.col("share") > F.col("was"), "gained").otherwise("lost"), F.col("share") * 100, F.col("was") * 100).alias("message"),
    )


def cooldown_key() -> Column:
    """Spikes and drops of an entity share one cooldown; movers share one whatever the region."""
    family = F.when(F.col("kind").startswith("anomaly"), "anomaly").when(F.col("kind").startswith("trend"), "trend").otherwise(F.col("kind"))
    entity = F.when(F.col("kind") == "top_mover", "region_share").otherwise(F.col("entity"))
    return F.concat_ws(":", family, F.col("metric"), entity)


def cooldown(insights: DataFrame, seconds: int = DEFAULTS.cooldown_seconds, strict: bool = False) -> DataFrame:
    """Drop insights that follow an emitted one of their key too soon, in event time; ``strict``: also just as the cooldown ends.

    A greedy choice: each depends on the last one kept. A time that comes late enough after the one before it is kept in any
    case, so a key's times fall apart into sessions there, and the choice is a fold over the times of a session.
    """
    gap = seconds * 1_000_000 + (1 if strict else 0)
    keyed = insights.withColumn("_key", cooldown_key()).withColumn("_at", F.unix_micros(F.col("window_start").cast("timestamp")))
    order = Window.partitionBy("_key").orderBy("_at")
    times = keyed.select("_key", "_at").distinct().withColumn("_new", F.coalesce(F.col("_at") - F.lag("_at").over(order) >= gap, F.lit(True)).cast("int"))
    times = times.withColumn("_session", F.sum("_new").over(order)).groupBy("_key", "_session").agg(F.sort_array(F.collect_list("_at")).alias("times"))
    empty = F.array().cast("array<bigint>")
    kept = F.aggregate("times", empty, lambda out, t: F.when((F.size(out) == 0) | (t - F.try_element_at(out, F.lit(-1)) >= gap), F.concat(out, F.array(t))).otherwise(out))
    return keyed.join(times.select("_key", F.explode(kept).alias("_at")), ["_key", "_at"]).select(*insights.columns)


def detect(rollup: DataFrame, config: Detection = DEFAULTS, cool: bool = True) -> DataFrame:
    """All four detectors over closed windows, then the cooldown."""
    found = anomalies(rollup, config).unionByName(trends(rollup, config)).unionByName(refund_rates(rollup, config)).unionByName(top_movers(rollup, config))
    return cooldown(found, config.cooldown_seconds, config.cooldown_strict) if cool else found
